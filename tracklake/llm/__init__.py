"""Operations of a training-data pipeline: filters, joins, mixing and encodings for text at scale."""
