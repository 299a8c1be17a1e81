"""License templates, the filter audit and conversation repair against plain versions."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from axiomloom.llm import conversation_repair as cr
from axiomloom.llm import filter_audit as fa
from axiomloom.llm import licenses as li

SMALL = "/root/testdata/sf0.001"


# ---- licenses --------------------------------------------------------------
def spans(automaton, text, size=li.STRETCH):
    return automaton.matches(li.stretches(text.encode(), size))[1]


def plain_spans(tree, words):
    """Every pair of places is tried against the pattern."""
    pattern = re.compile(li.as_pattern(tree))
    low = {}
    for end in range(1, len(words) + 1):
        for start in range(end):
            if pattern.fullmatch("".join(f"{w} " for w in words[start:end])):
                low[end] = start
                break
    out = {}
    for end, start in low.items():
        out[start] = max(end, out.get(start, 0))
    return sorted(out.items())


@pytest.mark.parametrize("markup", [
    "a b", "a <<beginOptional>>b<<endOptional>> c", "a <<var;name=\"x\";words=\"0-2\">> b", "a <<var;name=\"x\";words=\"1-\">> b",
    "<<beginOptional>>a b<<endOptional>> c <<beginOptional>>a<<endOptional>>", "<<var;name=\"x\";match=\"a|b a\">> c",
    "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> a<<endOptional>> <<var;name=\"x\";match=\"|b|c\">>",
    "<<var;name=\"x\";words=\"1-2\">> a b"])
def test_automaton_against_every_span(markup):
    tree = li.parse(markup)
    automaton = li.compiled((("t", markup),))
    rnd = random.Random(markup)
    for _ in range(300):
        words = [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]
        text = rnd.choice([" ", ", ", "\n* "]).join(words)
        want = plain_spans(tree, words)
        assert [(s, e) for _, s, e in spans(automaton, text)] == want, (markup, words)
        assert spans(automaton, text, 1) == spans(automaton, text)


MIT = li.TEMPLATES["mit-text"].replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", "").replace(
    '<<var;name="holder";words="1-30">>', "THE AUTHORS OR COPYRIGHT HOLDERS")


def test_mandatory_wording_has_to_match():
    automaton = li.compiled(tuple(li.TEMPLATES.items()))
    found = lambda text: {automaton.labels[t] for t, _, _ in spans(automaton, text)}
    assert found(f"# Copyright 2020\n{MIT}") == {"mit-text"}
    assert found(MIT.replace("\n", " ").upper()) == {"mit-text"}
    assert found(MIT.replace("THE AUTHORS", "THE (C) AUTHORS")) == {"mit-text"}
    for word in ("hereby", "merge", "TORT", "notice"):
        assert found(MIT.replace(word, "other")) == set()
    assert found("licensed under CC BY-NC-SA 4.0") == {"cc-by-nc-statement"}
    assert found("licensed under CC BY 4.0") == {"cc-by-statement"}
    assert found("licensed under CC BY ND 4.0") == set()


def test_templates_that_cannot_be_read():
    for markup in ("<<beginOptional>>a", "a<<endOptional>>", "<<other>> a", '<<var;name="x">> a', '<<var;name="x";words="1-3">>'):
        with pytest.raises(li.TemplateMarkupError):
            li.Automaton().add("t", li.parse(markup))


def test_license_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "MIT License, mit LICENSE; Apache license"), (4, "é" * 50), (None, "the General Public License"),
         (3, "MIT License, mit LICENSE; Apache license"), (5, "word " * 400_000 + "MIT license")], "doc_id int, text string"
    ).select("*", *[F.lit("x").alias(c) for c in ("kept", "t", "n_words", "matches", "labels", "score")])
    got = sorted(map(tuple, li.summary(li.license_scan(docs)).collect()), key=repr)
    assert got == sorted([
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 6, 3, 0, 4, "apache,mit", "apache,mit", 0.5),
        (3, 6, 3, 0, 4, "apache,mit", "apache,mit", 0.5), (4, 1, 0, None, None, "", "", 0.0), (None, 4, 1, 1, 1, "gpl", "gpl", 0.6),
        (5, 400_002, 1, 400_000, 400_000, "mit", "mit", 0.5)], key=repr)
    assert li.license_scan(docs.limit(0)).count() == 0


# ---- filter audit ----------------------------------------------------------
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_paths_against_every_order(k):
    passing = {}
    for order in permutations(range(k)):
        state = 0
        for f in order:
            passing[state, f] = passing.get((state, f), 0) + 1
            state |= 1 << f
    assert {(s, f): n for s, f, n in fa.edges(k)} == passing


def plain_audit(rows, labels):
    """rows: (doc_id, source, text)."""
    def fails(doc_id, text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        return {f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            re.search("[#$%&*|]", text) is not None,
            any(t == text and i is not None and doc_id is not None and i < doc_id for i, _, t in rows)), strict=True) if bad}
    rows = [(i, s or "", t or "") for i, s, t in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, totals = [], {}
    for part in {s for _, s, _ in rows}:
        docs = [(i, fails(i, t)) for i, s, t in rows if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
                out.append((part, order, step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                            sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
    return sorted((*r, totals[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_against_every_order(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n", "Short text.", "word " * 60, "# " + " ".join(map(str, range(60))), "AB cd " * 30, "é " * 70, " ".join(map(str, range(80)))]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, "", "a", "b"]), rnd.choice(texts)) for _ in range(120)]
    labels = [(rnd.choice([None, *range(30)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").select("*", *[
        F.lit("x").alias(c) for c in ("part", "t", "w", "digest", "f0", "good", "mask", "n", "first", "state")])
    known = spark.createDataFrame(labels, "doc_id int, quality int, toxic int").withColumn("good", F.lit("x"))
    got = sorted(map(tuple, fa.audit_documents(docs, known).collect()))
    assert got == plain_audit(rows, [x for x in labels if x[0] is not None])
    assert fa.audit_documents(docs.limit(0), known.limit(0)).count() == 0


# ---- conversation repair ---------------------------------------------------
def mended(rows, **options):
    one = cr.Repair(**options)
    edits = [e for i, (role, text) in enumerate(rows) for e in one.turn(i, role, text)] + one.close()
    cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e[0]] + (e[1] == "truncated" and e[0] != "D") for e in edits)
    return cost, "".join(e[0] for e in edits), [(e[4], e[5]) for e in edits if e[4] is not None]


@pytest.mark.parametrize("options", [{}, {"modulus": 3}, {"modulus": 7, "settle_at": 1}, {"settle_at": 1}])
def test_repair_against_every_edit(options):
    """A small modulus makes hashes collide; settling early returns edits at once."""
    rnd = random.Random(8)
    for _ in range(300):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b", "", "c!", " ", "x.", "y?"]))
                for _ in range(rnd.randint(0, 6))]
        assert mended(rows, **options) == cr.plain_repair(rows)


def test_long_conversations_settle():
    rows = [(("user", "assistant")[i % 2], f"turn {i}" + ".!? "[i % 4]) for i in range(30_000)]
    one, most = cr.Repair(), 0
    edits = []
    for i, (role, text) in enumerate(rows):
        edits += one.turn(i, role, text)
        most = max(most, len(one.rows))
    edits += one.close()
    assert most < 2_000 and "".join(e[0] for e in edits) == "K" * 30_000
    rows = [r for i, r in enumerate(rows) if i % 7]
    assert mended(rows)[:2] == mended(rows, settle_at=10**9)[:2]


def test_audits_compare_like_strings():
    rnd = random.Random(2)
    for modulus in (2, 5, (1 << 61) - 1):
        tree = cr.Audits(modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(tree.add(rnd.choice(nodes[-40:]), rnd.choice("DI")))
        for _ in range(2_000):
            a, b = rnd.choice(nodes), rnd.choice(nodes)
            assert tree.less(a, b) == (tree.spell(a) < tree.spell(b))
            d = rnd.randint(0, tree.depth[a])
            assert tree.spell(tree.ancestor(a, d)) == tree.spell(a)[:d]


def test_conversation_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hello."), (1, 1, "assistant", "hi"), (2, 0, None, None), (None, 3, "user", "q?"), (None, None, "system", "s."),
         (3, 5, "user", "q?"), (3, 5, "assistant", "a."), (3, 9, "user", "q?"), (4, 0, "user", "gone")],
        "conv_id int, turn int, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("r", "t", "p", "edit", "fault", "was", "there")])
    edits = cr.repair(turns, present=~F.coalesce(F.col("conv_id") == 4, F.lit(False)))
    got = {r["conv_id"]: tuple(r)[1:8] for r in cr.digests(edits).collect()}
    assert got == {1: (0, 0, 0, 1, 0, 1, "KK"), 2: (0, 1, 0, 0, 0, 3, "D"), None: (0, 0, 0, 0, 0, 2, "KKI"),
                   3: (3, 0, 1, 0, 1, 7, "IKKDI"), 4: (0, 0, 0, 0, 0, 0, "")}
    assert cr.digests(cr.repair(turns.limit(0))).count() == 0
    whole = cr.repair(turns).filter("role is not null").select("conv_id", "role", "text").collect()
    assert ("assistant", "") in [(r["role"], r["text"]) for r in whole]


def test_damaged_conversations_against_plain(spark):
    rows = cr.damaged(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    convs = {}
    for r in sorted(rows.collect(), key=lambda r: (r["turn"], r["role"], r["text"])):
        convs.setdefault(r["conv_id"], []).extend([(r["role"], r["text"])] if r["there"] else [])
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in cr.digests(cr.repair(rows, present=F.col("there"))).collect()}
    assert {c: mended(v)[:2] for c, v in convs.items()} == got
