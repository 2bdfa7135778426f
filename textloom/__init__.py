"""textloom: hybrid text retrieval and text processing as DataFrame plans."""
