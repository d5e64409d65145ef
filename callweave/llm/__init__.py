"""Operators for language-model training data. Nothing else in callweave imports this subpackage."""
