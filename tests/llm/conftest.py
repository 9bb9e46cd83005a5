from __future__ import annotations

import pytest

#: Columns that operators use inside; a table may have its own of the same names.
CLASHING = "row id n node fp key word place path tokens weight epoch value score first root block parts".split()

@pytest.fixture(scope="session")
def documents(spark):
    """documents with extra, clashing columns; rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows: list[tuple]):
        full = [tuple(r) + ("en", "src0")[len(r) - 2 :] + (0,) + (1,) * len(CLASHING) for r in rows]
        extra = ", ".join(f"{c} int" for c in CLASHING)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make
