"""A PySpark-native engine for ragged sequences, spatial point sets, surfaces and the graphs that connect them."""
