"""Operators of a training-data pipeline. The rest of the library does not depend on this subpackage."""
