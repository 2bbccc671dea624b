"""License scans, infilling and the Merkle manifest against plain Python, SQL, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gistmill.llm import entry, infilling, licenses, merkle

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, id long, row long, g string, hash string"
LAST = ("x", 1, 7, "g", "h")
ODD = [
    (1, "Hello\n\nwörld  \n x  under the MIT\nlicense, cc-by-nc CC BY NC", "en", "b", 1, *LAST),
    (2, None, None, None, None, None, None, None, None, None),
    (None, "", "en", "a", 0, *LAST),
    (None, "null id\n", "en", "é", 0, *LAST),
    (4, " \t\n", "en", "a", 0, *LAST),
    (4, "日本語　áb\x85 12 <S>\n\n \xa0 x", "en", None, 3, *LAST),
    (4, "日本語　áb\x85 12 <S>\n\n \xa0 x", "en", None, 3, *LAST),
    (5, "x" * 9000 + " " + "ab \n" * 30_000 + "GNU General  Public License\n version 3", "fr", "c", 9, *LAST),
    (6, "a  b \n  c\n\n  d \n e\t\tf  ", "de", "c", 9, *LAST),
    (7, "<", "de", "c", 9, *LAST),
]
NAMES = ("op11_license_scan", "op12_fill_in_middle", "op13_merkle_manifest")
QUERY = {"op11_license_scan": licenses.op11, "op12_fill_in_middle": infilling.op12, "op13_merkle_manifest": merkle.op13}


def plain(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=repr)


def by_sql(name, path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[names.index(c)] for c in sorted(names))) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert plain(entry.queries()[name](spark, DATA)) == by_sql(name, f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_equal_sql(odd, name, tmp_path):
    odd.coalesce(1).write.parquet(f"{tmp_path}/odd")
    assert plain(QUERY[name](odd)) == by_sql(name, f"{tmp_path}/odd/*.parquet")
    assert plain(QUERY[name](odd.limit(0))) == []


def scan_brute(text, templates, threshold):
    """Labels of every paragraph by plain sets."""
    found = set()
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    groups, now = [], []
    for line in [*lower.split("\n"), ""]:
        if words_of(line):
            now += words_of(line)
        elif now:
            groups.append(now)
            now = []
    for label, template in templates:
        wanted = words_of(template.lower())
        wanted = set(zip(wanted, wanted[1:], strict=False))
        if len(wanted) >= licenses.MIN_TOKENS:
            found |= {(label, round(len(wanted & have) / len(wanted), 9)) for g in groups if len(wanted & (have := set(zip(g, g[1:], strict=False)))) >= threshold * len(wanted) - 1e-9}
    return sorted(found)


def test_op11_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(25)]
    templates = [(f"t{k}", " ".join(rng.choices(words, k=rng.randint(2, 30)))) for k in range(40)]
    docs = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(templates)[1].split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                part[rng.randrange(len(part))] = rng.choice(words)
            parts.append(" ".join(rng.choices(words, k=rng.randint(0, 5)) + part))
        docs.append((i, rng.choice(("\n\n", "\n", "\n- \n")).join(parts)))
    for threshold in (0.5, 0.9):
        got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, threshold, ()).collect()
        assert {r.doc_id: sorted({(m.label, round(m.containment, 9)) for m in r.matches or ()}) for r in got} == {i: scan_brute(t, templates, threshold) for i, t in docs}


def test_op11_finds_notices_and_spares_clean_text(spark):
    notices = [label for label, _ in licenses.TEMPLATES]
    given = [(i, f"Some lines before.\n\n// {t}\n\nand after") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    clean = ["The general public may license version 3 of the software.", "A GNU is an animal of the general plains.", "Permission is granted to use the hall free of charge to any person."]
    other = ["GNU General Public License version 4", "GNU Library General Public License, version 2"]
    rows = {r.doc_id: r for r in licenses.op11(spark.createDataFrame(given + [(-1 - k, t) for k, t in enumerate(clean + other)], "doc_id long, text string")).collect()}
    for i, label in enumerate(notices):
        assert label in rows[i].labels.split(","), (label, rows[i])
    assert all(rows[-1 - k].labels == "" and rows[-1 - k].score == 0 for k in range(len(clean) + len(other)))


def test_op11_matches_name_blocks(spark):
    (row,) = licenses.scan(spark.createDataFrame([(1, "one two\n\nthree\nthis is gpl: GNU General Public License version 3, yes")], "doc_id long, text string")).collect()
    assert [(m.first_word, m.n_words, m.label, m.containment) for m in row.matches] == [(2, 11, "gpl-3", 1.0)]


def test_op11_bounds_templates(spark):
    with pytest.raises(ValueError):
        licenses.Templates([("x", "a b c " * 3_000_000)], 0.9)


@pytest.mark.parametrize("leaf", (1, 7, 2048))
def test_rope_splits_anywhere(leaf, monkeypatch):
    monkeypatch.setattr(infilling, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(150):
        text = "".join(rng.choices(" \n\tab<é日\x85　", k=rng.randint(0, 60)))
        units = infilling.UNIT.findall(text)
        rope = infilling.rope_of(text)
        assert (str(rope), rope.units, rope.chars) == (text, len(units), len(text))
        for at in range(len(units) + 1):
            a, b = infilling.split(rope, at)
            assert (str(a), str(b), a.units, b.units) == ("".join(units[:at]), "".join(units[at:]), at, len(units) - at)
            assert a.chars == len(str(a)) and b.chars == len(str(b))
        for at in range(len(text) + 1):
            a, b = infilling.split(rope, at, "chars")
            assert (str(a), str(b)) == (text[:at], text[at:])
        for k in range(40):
            n, form, _, _, out = infilling.arranged(text, k, 1, 100, 50)
            assert n == len(units) and infilling.put_back(out, form) == text


def test_op12_rates_and_columns(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"), F.col("id").alias("output"))
    made = docs.select("*", infilling.infilled(F.col("text"), F.col("doc_id")).alias("made"))
    forms = {r.form: r["count"] for r in made.groupBy("made.form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150 and forms["psm"] > 300
    assert made.where(infilling.restored(F.col("made.output"), F.col("made.form")) != F.col("text")).isEmpty()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of a list of hashes, and each one's path of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = place - place % 3
            paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes, at = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


@pytest.mark.parametrize("sizes", ([1], [5], [1, 1, 1, 1], [400, 3, 1, 27, 28, 1, 9]))
def test_op13_equals_plain_python(spark, sizes):
    docs = [(1000 * s + i, f"t{i}\n{s}", "en", f"s{s}" if s else None, i) for s, n in enumerate(sizes) for i in range(n)]
    leaf = lambda d, text: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)))
    groups = defaultdict(list)
    for d in docs:
        groups[d[3] or ""].append(d)
    subs = {g: tree([leaf(d, d[1]) for d in ds]) for g, ds in groups.items()}
    names = sorted(groups)
    root, over = tree([subs[g][0] for g in names])
    want = []
    for at, g in enumerate(names):
        for d, path in zip(groups[g], subs[g][1], strict=True):
            bad = d[1].replace("\n", "") if zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[1]
            fold = leaf(d, bad)
            for before, after in path + over[at]:
                fold = h(before, fold, after)
            want.append((d[0], leaf(d, d[1]), subs[g][0], root, h(*(b + a for b, a in path + over[at])), fold, fold == root))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(tuple(r) for r in merkle.op13(frame).collect()) == sorted(want)
    assert any(not w[-1] for w in want) or len(docs) < 5


@pytest.mark.parametrize("fanout", (2, 5))
def test_manifest_proofs_fold_to_the_root(spark, fanout):
    rows = spark.range(500).select("id", (F.col("id") % 7 * F.lit(0) + F.when(F.col("id") < 170, 0).otherwise(F.col("id") % 11)).alias("s"))
    made = merkle.manifest(rows, F.col("s"), merkle.leaf_hash([F.col("id")]), ["id"], fanout=fanout)
    assert made.select("root").distinct().count() == 1
    assert made.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty() and made.count() == 500
