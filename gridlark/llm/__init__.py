"""Operations on training data for language models; nothing else in gridlark imports this subpackage."""
