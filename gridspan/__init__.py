"""gridspan: a PySpark-native engine for gridded city maps, level-of-detail pyramids and view queries."""
