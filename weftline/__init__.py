"""A PySpark-native engine for finding gene fusions in long-read RNA sequencing, with operators for corpus preparation."""
