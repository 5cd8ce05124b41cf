"""Operations of a training-data pipeline on tables of texts, pages and conversations."""
