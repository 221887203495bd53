import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as P
from cellweave.llm import bpe, linededup, mix, quality, simhash


def test_stages_compose(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    docs, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        text = (good + f" unit{i} part{i * 7}\n" + "\n".join(f"line {i} {k} of its own" for k in range(3))) if not bad else " ".join(f"W{k * i % 97}!!" for k in range(60)).upper()
        if i % 10 == 1:
            text = docs[1][1] if i > 1 else text
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    cols = list(zip(*docs))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": cols[1], "lang": cols[2], "source": cols[3], "n_chars": pa.array(cols[4], pa.int64())}), tmp_path / "documents.parquet")
    a = list(zip(*labels))
    pq.write_table(pa.table({"doc_id": pa.array(a[0], pa.int64()), "quality": pa.array(a[1], pa.int32()), "toxic": pa.array(a[2], pa.int32())}), tmp_path / "labels.parquet")
    sf = str(tmp_path)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        d = stage(spark, d, sf)
        if name != "encode":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [tuple(r) for r in d.collect()]
        if name != "encode":
            d = spark.createDataFrame(kept[name], d.schema)
    assert {r[0] for r in kept["quality"]} == {i for i in range(120) if i % 4}
    assert len(kept["lines"]) == len(kept["quality"]) and all(r[4] == len(r[1]) for r in kept["lines"])
    assert {r[0] for r in kept["near duplicates"]} <= {r[0] for r in kept["lines"]}
    assert len({r[0] for r in kept["near duplicates"]}) == len(kept["near duplicates"])
    assert len(kept["encode"]) == len(kept["mix"])
    whole = sorted(tuple(r) for r in P.run(spark, sf).collect())
    assert whole == sorted(kept["encode"])
    assert {bpe, linededup, mix, quality, simhash}
