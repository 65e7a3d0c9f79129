"""DataFrame -> DataFrame operators. All of them are lazy except model training."""
