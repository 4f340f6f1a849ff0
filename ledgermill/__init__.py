"""ledgermill: financial-facts analytics on PySpark, declared as DataFrame plans."""
