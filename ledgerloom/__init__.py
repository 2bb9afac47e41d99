"""ledgerloom: document and fact analytics expressed as Spark plans."""
