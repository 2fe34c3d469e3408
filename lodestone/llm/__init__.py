"""Operations of a training-data pipeline over `documents`, `embeddings` and `benchmark`.

Nothing else in the library imports this subpackage; it imports nothing of the rest.
"""
