"""Tables of records and indexes that are kept, published and cleaned up."""
