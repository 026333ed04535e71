"""Set-wise operators over the triples of a dataset."""
