from quarry.sources.tables import load_table, files_from_documents  # noqa: F401
