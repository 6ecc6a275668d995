"""Training-data operators. Nothing else in lakelens imports this subpackage."""
