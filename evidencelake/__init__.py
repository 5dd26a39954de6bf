"""evidencelake: a PySpark-native engine for checkable answers over facts and text."""
