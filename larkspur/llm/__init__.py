"""Training-data operators: ten scale-first building blocks over document, vector and page tables."""
