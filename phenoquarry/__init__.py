"""PySpark-native engine for image-derived plant-structure evidence tables."""
