import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """documents from (doc_id, text[, source[, lang]]) rows; ``clash`` adds
    columns named like the operators' own."""
    def make(rows, clash=False):
        full = [(r[0], r[1], (list(r) + [None] * 4)[3], (list(r) + [None] * 4)[2],
                 None if r[1] is None else len(r[1])) for r in rows]
        extra = ["key", "fp", "n", "m", "mask", "h", "block", "size", "row", "blob", "spans", "j", "ids"]
        schema = SCHEMA + "".join(f", {c} string" for c in extra) if clash else SCHEMA
        return spark.createDataFrame([(*r, *["x"] * len(extra)) if clash else r for r in full], schema)
    return make


@pytest.fixture()
def tables(tmp_path):
    """Writes frames as a driver folder and returns its path."""
    def write(**frames):
        for name, df in frames.items():
            df.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write
