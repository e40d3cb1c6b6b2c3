import pytest

VOCAB = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "nu", "re", "so", "la", "mi", "ve", "du") for b in ("ran", "lo", "mes", "tik", "our") for c in ("a", "en", "os", "ik")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture
def docs_of(spark):
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        full = [(*r, *[None] * (5 - len(r))) if schema.startswith("doc_id bigint, text string, lang") else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make


def same(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
