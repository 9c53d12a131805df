"""Operations of a training-data pipeline over document corpora, each a function from DataFrame to DataFrame."""
