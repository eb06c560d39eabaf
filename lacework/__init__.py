"""A PySpark-native engine for network inference between the variables of a large matrix."""
