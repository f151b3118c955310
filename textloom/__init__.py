"""textloom: DataFrame-native preparation, exploration and evaluation of large text datasets."""
