"""The corpus pipeline against a plain recomputation of its five stages, and packing's rule against its definition."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_parity_join import components

import corpus_pipeline
from parley.llm import decontamination, packing, quality_rules

COLUMNS = [("doc_id", pa.int64()), ("text", pa.string()), ("__kept", pa.int32()), ("row", pa.string()), ("sig", pa.int64())]
WIDTH = 400


def without_repeats(texts):
    """Each text less every byte that a repeated string of WIDTH bytes covers."""
    data, count = [t.encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - WIDTH + 1):
            count[d[i : i + WIDTH]] = count.get(d[i : i + WIDTH], 0) + 1
    out = []
    for d in data:
        left = bytearray(b"\1" * len(d))
        for i in range(len(d) - WIDTH + 1):
            if count[d[i : i + WIDTH]] > 1:
                left[i : i + WIDTH] = bytes(WIDTH)
        out.append(bytes(b for b, k in zip(d, left, strict=True) if k).decode("utf-8", "ignore"))
    return out


def expected(rows, items):
    """doc_id and text after each of the four filtering stages."""
    table = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    con = duckdb.connect()
    con.register("documents", table)
    kept = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.oracle_sql()}) where kept").fetchall()}
    stages = [[r for i, r in enumerate(rows) if i in kept]]
    best = {}
    roots, _ = components(stages[0], 5, 80)
    for root, r in zip(roots, stages[0], strict=True):
        key = root if root is not None else r[1]
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] < best[key][0])):
            best[key] = r
    stages.append(list(best.values()))
    stages.append([(i, t) for (i, _), t in zip(stages[1], without_repeats([t for _, t in stages[1]]), strict=True) if t])
    bad = {i for i, _ in decontamination.brute([(k, t) for k, (_, t) in enumerate(stages[2])], items)}
    stages.append([r for k, r in enumerate(stages[2]) if k not in bad])
    return stages


@pytest.fixture(scope="module")
def corpus(sf_dir):
    """Documents of the table with copies, near copies, shared passages, benchmark items and odd rows among them."""
    rng = random.Random(12)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()][:120]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    long = [(i, t) for i, t in docs if len(t.split()) > 80]
    rows = [(i, t[:6000]) for i, t in docs]
    rows += [(10_000 + i, t[:6000]) for i, t in long[:10]]
    for i, t in long[10:22]:
        words = t[:6000].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((20_000 + i, " ".join(words)))
    passage = long[30][1][:700]
    rows += [(30_000 + i, f"{t[:900]} é{passage}é {t[900:1500]}") for i, t in long[40:48]]
    rows += [(40_000 + k, f"{long[k][1][2000:2600]} {t} {long[k][1][2600:3200]}") for k, (_, t) in enumerate(items[:10])]
    rows += [(50_000, None), (50_001, ""), (50_002, " \n "), (None, long[5][1][:6000]), (None, long[25][1][300:1500]), (50_003, "few words")]
    rng.shuffle(rows)
    return rows, items


def write(folder, rows, items):
    columns = [[i for i, _ in rows], [t for _, t in rows], *([None] * len(rows) for _ in COLUMNS[2:])]
    pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS, strict=True)], names=[n for n, _ in COLUMNS]), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    return str(folder)


def test_every_stage_against_plain_python(spark, tmp_path, corpus):
    rows, items = corpus
    folder = write(tmp_path, rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    want = expected(rows, items)
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[3]) > 50
    for (name, stage), left in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "stage")
        assert docs.columns == [n for n, _ in COLUMNS]
        assert sorted(map(str, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(str, left)), name


def test_whole_pipeline_against_plain_python(spark, tmp_path, corpus):
    from tokenizers import Tokenizer

    rows, items = corpus
    got, t = {}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences = {}
    for r in corpus_pipeline.run(spark, write(tmp_path, rows, items)).collect():
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, text in expected(rows, items)[-1]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (i, len(ids)) not in want
        want[i, len(ids)] = ids
    assert got.keys() == want.keys()
    for key, pieces in got.items():
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and crc == zlib.crc32(want[key][start : start + length].tobytes())
            at += length
        assert at == key[1]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_of_odd_tables(spark, tmp_path):
    for name, rows, items in (("none", [], []), ("odd", [(1, None), (1, ""), (None, None), (2, " ")], [(1, None)])):
        folder = tmp_path / name
        folder.mkdir()
        assert corpus_pipeline.run(spark, write(folder, rows, items)).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng, window = random.Random(3), 24
    packer, counts = packing.Packer(window), [0] * window
    for k in range(600):
        size = rng.randint(1, window - 1)

        def cost(level, size=size):
            c = list(counts)
            if level:
                c[level] -= 1
            if level + size < window:
                c[level + size] += 1
            return sum(x * x for x in c)

        feasible = [level for level in range(window - size + 1) if not level or counts[level]]
        least = min(map(cost, feasible))
        level = max(x for x in feasible if cost(x) == least)
        assert packer.level(size) == level
        list(packer.put(k, np.zeros(size, np.uint32)))
        if level:
            counts[level] -= 1
        if level + size < window:
            counts[level + size] += 1
        assert packer.count.tolist() == counts
