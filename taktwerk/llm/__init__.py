"""Training-data operators: thirteen corpus transforms over the tables documents, pages, embeddings and conversations."""
