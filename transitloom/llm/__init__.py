"""Training-data operators: filters, duplicate removal, search, tokens, packing and archives."""
