from tessera.sources.corpus import read_corpus, read_table, text_column, select_text, pin  # noqa: F401
