"""Operations for training-data pipelines; the rest of the library does not import this subpackage."""
