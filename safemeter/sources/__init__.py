"""Reading and writing: the corpus file and the run store."""
