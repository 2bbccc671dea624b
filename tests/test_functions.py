import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from gistmill.functions import chunking, ids
from gistmill.functions import text as X
from gistmill.functions import vectors as V
from gistmill.operators import textindex


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_digests_equal_hashlib(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcé ß😀") for _ in range(rng.randint(0, 9))), str(rng.random())) for _ in range(1000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ids.digest("a", "b").alias("d")).collect()
    assert all(r.d == hashlib.sha256(f"{r.a}\x1f{r.b}".encode()).hexdigest()[:24] for r in got)
    assert one(spark, ids.digest(F.lit(None), F.lit("a"))) != one(spark, ids.digest(F.lit("a")))


def test_content_hash_ignores_key_order(spark):
    rows = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{"a":"é", "b":1}',)], "j string")
    assert len({r.h for r in rows.select(ids.content_hash("j").alias("h")).collect()}) == 1
    assert one(spark, ids.pair_key(F.lit("b"), F.lit("a"))) == one(spark, ids.pair_key(F.lit("a"), F.lit("b")))


def test_entity_keys(spark):
    same = [("Drive D:", "drive d"), ("Challenge fees", "challenge fee"), ("Some-Thing", "some thing"), ("a_b", "A  B")]
    other = [("C++", "C"), ("C#", "C"), ("bus", "bu"), ("class", "clas"), ("basis", "basi")]
    for a, b in same:
        assert one(spark, X.entity_key(F.lit(a))) == one(spark, X.entity_key(F.lit(b)))
    for a, b in other:
        assert one(spark, X.entity_key(F.lit(a))) != one(spark, X.entity_key(F.lit(b)))


def test_text_helpers(spark):
    assert one(spark, X.fact_key(F.lit("We  chose Rust. "))) == "we chose rust"
    assert [one(spark, X.strength(F.lit(x))) for x in (2.5, 3.5, 99.0, -1.0)] == [2, 4, 10, 1]
    assert one(spark, X.strength(F.lit(None))) == 5
    assert one(spark, X.tokens(F.lit("Café's customer_id 12"))) == ["cafe", "s", "customer", "id", "12"]
    assert X.query_words('NOT "customer_id" Café') == [["not"], ["customer", "id"], ["cafe"]]
    assert one(spark, X.wikilinks(F.lit("[[b#x|y]] [[ a ]] [[b]] [[#z]]"))) == ["a", "b"]
    assert one(spark, X.safe_path(F.lit("../a:b/./c?.txt"))) == "a_b/c_.txt" and one(spark, X.safe_path(F.lit("../"))) == "upload"
    assert one(spark, X.canonical_type(F.lit("app"))) == "tool" and one(spark, X.canonical_type(F.lit("x"))) == "x"
    assert one(spark, X.shorten_tool_text(F.lit("x" * 3234))).endswith("\n[1,234 more characters]")
    assert one(spark, X.token_estimate(F.lit("é" * 9))) == 2 and one(spark, X.token_estimate(F.lit(""))) == 1
    assert one(spark, X.ngrams(F.split(F.lit("a b c"), " "), 2)) == ["a b", "b c", "a", "b", "c"]
    assert X.fold_text("Ἀθήνα straße") == ["αθηνα", "strasse"]


def test_index_and_query_fold_alike(spark):
    """Every character that the oldest of the libraries' Unicode versions knows, alone and inside a word."""
    chars = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Co")]
    texts = [t for c in chars for t in (c, f"a{c}b")]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.tokens(F.col("t")).alias("w")).collect()
    assert [(texts[r.i], r.w, X.tokens_of(texts[r.i])) for r in got if r.w != X.tokens_of(texts[r.i])] == []


@pytest.mark.parametrize("word", ["Straße", "мой", "Дом", "がく", "か\u3099く", "한국어", "日本語", "سلام", "ΟΔΟΣ", "οδός", "ﬁnd", "Café", "Cafe\u0301", "résumé", "re\u0301sume\u0301", "İstanbul", "x_y", "٣٤"])
def test_words_of_any_script_are_found(spark, word):
    docs = spark.createDataFrame([(1, f"one {word}, two"), (2, "other words")], "doc_id long, text string")
    assert [r.doc_id for r in textindex.search(docs, word).collect()] == [1]


def test_vectors(spark):
    assert one(spark, V.normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.l2(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 2.0


def test_chunks_pack_paragraphs_and_keep_fences():
    chunk = chunking.chunk_text
    assert chunk([("text", "a\n\nb")]) == ["a\n\nb"]
    fenced = "intro\n\n```py\nx = 1\n\n\ny = 2\n```\n\nend"
    assert chunk([("text", fenced)]) == ["intro\n\n```py\nx = 1\n\n\ny = 2\n```\n\nend"]
    long = " ".join(f"Sentence number {k} is here." for k in range(200))
    parts = chunk([("text", long)], 50, 10)
    assert all(len(p) <= 200 for p in parts) and len(parts) > 20
    assert max(map(len, chunk([("text", "x" * 5000)]))) == 1600
    assert chunk([("other", "seen by nobody"), ("code", "  ")]) == []
    tail = chunk([("text", "a" * 1000 + "\n\nshort tail\n\n" + "b" * 1000)])
    assert tail[1].startswith("short tail\n\n")
    assert chunk([("text", "```\nnever closed\n\nprose")]) == ["```\nnever closed\n\nprose"]


def test_chunks_of_messages(spark):
    rows = [("m1", "user", "hello"), ("m2", "system", "hidden"), ("m3", "assistant", None), ("m4", "assistant", "word " * 1000)]
    got = chunking.chunks(spark.createDataFrame(rows, "id string, role string, text string")).collect()
    assert {r.id for r in got} == {"m1", "m4"} and len([r for r in got if r.id == "m4"]) == 4
    again = chunking.chunks(spark.createDataFrame(rows, "id string, role string, text string")).collect()
    assert sorted(r.chunk_id for r in got) == sorted(r.chunk_id for r in again)


def packed_brute(units, most, overlap):
    """Stepping over prose units one by one."""
    done, now = [], []
    for u in units:
        if now and len("\n\n".join([*now, u])) > most:
            done.append(now)
            now = [now[-1]] if len(now[-1]) <= overlap and len(now[-1]) + 2 + len(u) <= most else []
        now = [*now, u]
    return ["\n\n".join(c) for c in [*done, now] if c]


def test_packing_equals_stepping():
    rng = random.Random(6)
    for _ in range(3000):
        units = ["u" * rng.choice((1, 2, 3, 8, 19, 20)) for _ in range(rng.randint(1, 30))]
        for overlap in (0, 3, 9):
            assert chunking.pack(units, [False] * len(units), 20, overlap) == packed_brute(units, 20, overlap)


def test_fences_pair_with_the_next_of_their_kind():
    units = chunking.markdown_units
    assert units("a\n```\nb\n\nc\n```\nd") == (["a", "```\nb\n\nc\n```", "d"], [False, True, False])
    assert units("~~~\nx\n```\ny\n```") == (["~~~\nx", "```\ny\n```"], [False, True])
    assert units("```\nx\n~~~\n\ny") == (["```\nx\n~~~", "y"], [False, False])


def test_a_text_of_many_units_is_linear():
    for glue in ("\n\n", ". "):
        text = glue.join(f"unit {k} of a text" for k in range(200_000))
        got = chunking.chunk_text([("text", text)])
        assert max(map(len, got)) <= 1600 and len(got) > 2000
