from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark, tmp_path):
    """Rows (doc_id, text[, lang[, source]]) as a table in a file, with extra columns whose names the operators use inside."""
    made = [0]

    def make(*rows, extra: bool = True):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)
        if extra:
            for name in ("row_key", "_row_key", "cls", "kept", "size", "score", "_toxicity", "_draws", "digest", "n"):
                df = df.selectExpr("*", f"cast(null as string) as `{name}`")
        made[0] += 1
        path = str(tmp_path / f"t{made[0]}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make
