"""Operations of a training-data pipeline; nothing else in groundloom imports this."""
