"""Retail analytics on PySpark: reports, forecasts, decisions and order documents as DataFrame operators."""
