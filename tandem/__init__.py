"""tandem: pair alignment and scoring of loosely labelled text records on Spark."""
