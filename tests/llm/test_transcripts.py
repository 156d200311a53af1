import itertools
import zlib

import numpy as np
import pytest

from lodestone.llm import transcripts as tr

from .conftest import clashing

MODEL = tr.model_of(*tr.prior())


@pytest.mark.parametrize("text, roles", [
    ("User: hi\nAssistant: hello\nmore\n\nUser: bye", ["user", "assistant", "user"]), ("### User:\nhi\n### Assistant:\nhello", ["user", "assistant"]), ("[system] be kind\n[user] hi\n[assistant] yes", ["system", "user", "assistant"]),
    ("Ada: how are you?\nBen: fine\nAda: good", ["user", "assistant", "user"]), ("Human: a\nAI: b\nFunction: c\nAI: d", ["user", "assistant", "tool", "assistant"]), ("", []),
])
def test_roles(text, roles):
    assert [r for r, _ in tr.turns_of(MODEL, text)] == roles


def test_markers_inside_a_turn_stay():
    turns = tr.turns_of(MODEL, "User: please\nAssistant: steps\nnote: careful\nthe end is: near")
    assert turns == [("user", "please"), ("assistant", "steps\nnote: careful\nthe end is: near")]
    assert tr.rendered(turns).startswith("<|user|>\nplease<|end|>\n<|assistant|>\n")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(20):
        seen = np.stack([rng.integers(0, v, 4) for v in tr.SIZES], 1)

        def worth(path, seen=seen):
            said = sum(MODEL.emit[k][s, seen[t, k]] for t, s in enumerate(path) for k in range(len(tr.SIZES)))
            return MODEL.start[path[0]] + said + sum(MODEL.move[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(worth(p) for p in itertools.product(range(len(tr.STATES)), repeat=4))
        assert worth(tr.viterbi(MODEL, seen)) == pytest.approx(best)


def brute(spark, rows, model, schema="conv_id long, turn long, role string, text string"):
    """Turns by decoding each conversation as one text. Segments give the markers; their order the rest."""
    segments = tr.raw_segments(spark.createDataFrame(rows, schema), 10**9).collect()
    texts = {}
    for r in sorted(segments, key=lambda r: r.segment):
        texts[r.conv] = r.transcript if r.conv not in texts else texts[r.conv] + "\n" + r.transcript
    return sorted((c, k, *t) for c, text in texts.items() for k, t in enumerate(tr.turns_of(model, text)))


def talk(conv, turns, rng):
    """Turns with blank lines, marker-like lines, questions and turns that end in the middle of a segment."""
    said = ("Why so?", "It is.\nAnd more of it.", "Note: not a marker\n\nbut text", "User: quoted", "", "one\n\n\ntwo", "Fine.")
    return [(conv, k, "system" if k == 0 else ("user", "assistant", "tool")[int(rng.integers(0, 3)) if k % 5 == 0 else k % 2], said[int(rng.integers(0, len(said)))]) for k in range(turns)]


@pytest.mark.parametrize("most", [1, 3, 7, 256])
def test_segments_are_decoded_as_one(spark, most):
    rng = np.random.default_rng(most)
    rows = [r for conv in range(12) for r in talk(conv, 40, rng)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = tr.train(tr.raw_segments(df))
    got = sorted((r.conv, r.turn, r.role, r.content) for r in tr.parse_segments(tr.raw_segments(df, most), model).collect())
    assert got == brute(spark, rows, model)


def test_a_long_conversation(spark):
    """3,000 turns between named people: the roles hold to the end."""
    rows = [(4, k, ("user", "assistant")[k % 2], f"turn {k} says this and that.") for k in range(3000)]  # style of names
    conv = next(k for k in range(100) if spark.sql(f"SELECT pmod(xxhash64('{k}'), {len(tr.STYLES)})").first()[0] == len(tr.STYLES) - 1)
    df = spark.createDataFrame([(conv, *r[1:]) for r in rows], "conv_id long, turn long, role string, text string")
    out = tr.parse_segments(tr.raw_segments(df), MODEL).collect()
    assert sorted((r.turn, r.role, r.content) for r in out) == [r[1:] for r in rows]
    assert tr.raw_segments(df).count() >= 12


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {(r.conv_id, r.turn): (r.role, r.text.strip()) for r in spark.read.parquet(f"{d}/conversations.parquet").collect() if zlib.crc32(str(r.conv_id).encode()) % 5 == 0}
    whole = tr.raw_segments(spark.read.parquet(f"{d}/conversations.parquet"))
    model = tr.train(whole.filter("crc32(cast(cast(conv_id AS string) AS binary)) % 5 <> 0"))
    got = {(r.conv, r.turn): (r.role, r.content) for r in tr.parse_segments(whole, model).collect()}
    assert len(truth) > 50 and sum(got.get((f"c{i}", k)) == v for (i, k), v in truth.items()) / len(truth) > 0.97


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "assistant", None), (None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, None, "b"), (2, 0, "narrator", "c"), (3, 600, "user", "late"), (3, 0, "user", "early"), (4, 0, "user", "x\n" * 5000)]
    df = spark.createDataFrame(rows, schema)
    whole = tr.raw_segments(clashing(df, "Conv", "segment", "PLACE", "hash", "c0"))
    assert whole.filter("conv_id = 3").count() == 1 and whole.filter("conv_id is null").count() == 3
    model = tr.train(whole)
    out = tr.parse_segments(whole, model).collect()
    assert sum(r.conv.startswith("n") and r.content == "a" for r in out) == 2 and any(r.content == "late" for r in out) and all(r.role in tr.ROLES for r in out)
    many = tr.raw_segments(spark.range(3000).selectExpr("9L AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text"))
    assert many.count() >= 12 and many.selectExpr("sum(size(turns))").first()[0] == 3000 and tr.parse_segments(many, model).filter("content = 'same'").count() == 3000
    none = tr.raw_segments(spark.createDataFrame([], schema))
    assert tr.parse_segments(none, tr.train(none)).count() == 0


def test_transcripts_of_one_row(spark):
    rows = spark.createDataFrame([(1, "User: hi\nAssistant: yes", "x"), (2, None, "y")], "turn long, transcript string, `Role` string")
    got = tr.parse(rows).collect()
    assert tr.parse(rows).columns == ["turn", "role", "content", "formatted"] and [(r.turn, r.role, r.content) for r in got] == [(0, "user", "hi"), (1, "assistant", "yes")]


def test_query(spark, sf_dir, table):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table("conversations").collect()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = tr.train(tr.raw_segments(df).filter("crc32(cast(cast(conv_id AS string) AS binary)) % 5 <> 0"))
    got = sorted((f"c{r.conv_id}", r.turn, r.role, r.n_chars, r.content_sha256) for r in tr.op9(spark, sf_dir).collect())
    assert got == [(c, k, role, len(text), tr.digest(text)) for c, k, role, text in brute(spark, rows, model)]
