"""What op10 learns, what it adds, and how long odd texts take."""

import random
import string
import time

import plain
from pyspark.sql import functions as F

from wayfold.llm import pii


def test_reliabilities_of_planted_votes():
    """Labelers of known hit and false-alarm rates: the estimates come close to them."""
    random.seed(5)
    rates = [(0.95, 0.02), (0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.85, 0.15)]
    counts: dict = {}
    for _ in range(40_000):
        yes = random.random() < 0.3
        votes = tuple((1 if random.random() < (a if yes else b) else 0) if random.random() < 0.8 else -1 for a, b in rates)
        counts[votes] = counts.get(votes, 0) + 1
    prior, tables = pii._reliabilities(counts)
    import math

    assert abs(1 / (1 + math.exp(-prior)) - 0.3) < 0.03
    for (hit, alarm), table in zip(rates, tables, strict=True):
        p = {v: (math.exp(a), math.exp(b)) for v, (a, b) in table.items()}
        assert abs(p[1][0] / (p[1][0] + p[0][0]) - hit) < 0.05
        assert abs(p[1][1] / (p[1][1] + p[0][1]) - alarm) < 0.05


def test_planted_secrets_are_found_and_plain_numbers_are_not(spark):
    random.seed(6)
    word = lambda: "".join(random.choice(string.ascii_lowercase) for _ in range(random.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, secrets = [], {}
    for i in range(1500):
        text = f"{prose(20)} {random.choice(['in 1987', 'page 12', 'about 40', 'version 2.1', 'at 10:30', '3rd', 'on 7/8', 'costs $4.50', 'b2'])} {prose(10)}"
        if i % 5 == 0:
            kind = random.randrange(4)
            secret = "".join(random.choice("0123456789abcdef") for _ in range(40)) if kind % 2 else "".join(random.choice(string.ascii_letters + string.digits) for _ in range(24)) + "a1B"
            text += f" {['token = ', 'api_key=', 'password: ', 'secret='][kind]}{secret} {prose(5)}"
            secrets[i] = (text.index(secret), text.index(secret) + len(secret))
        rows.append((i, text))
    random.shuffle(rows)
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r.doc_id: [(s.start, s.stop) for k in pii.EXTRA for s in r[k]] for r in out}
    hit = sum(secrets[i] in added[i] for i in secrets)
    assert hit >= 0.95 * len(secrets)
    assert sum(len(a) for a in added.values()) - hit <= 0.05 * len(secrets)


def test_a_named_short_code_is_likelier_than_an_unnamed_one(spark):
    """The labelers by name and by context vote on what no shape gives away."""
    c = F.struct(F.lit("x1234").alias("s"), F.col("near"))
    df = spark.createDataFrame([("row of the table ",), ("the password: ",), ("my login is ",)], "near string").select(*(f(c).alias(k) for k, f in pii.LABELERS.items()))
    plain_row, named, context = df.collect()
    assert (plain_row.named, plain_row.context) == (-1, -1) and (named.named, named.context) == (1, 1) and (context.named, context.context) == (-1, 1)


def odd_texts(size):
    quotes = '"' * size
    return ["1" + "." * size + "x", "key=" * (size // 4) + "1", "a" * size + "1", "1" * size, "+1" + "(" * size, "a@" * (size // 2), f"{quotes}7{quotes}", "a@b.cc 10.0.0.1 " * (size // 25), "1 " * (size // 5)]


def test_long_runs_and_many_matches(spark):
    """Right on long runs, and fast on very long ones."""
    find = lambda texts: pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    texts = odd_texts(3000)
    for row in find(texts):
        assert [(k, s.start, s.stop) for k in pii.KINDS for s in row[k]] == plain.base_spans(texts[row.doc_id])
    start = time.time()
    assert len(find(odd_texts(100_000))) == len(texts)
    assert time.time() - start < 100


def test_runs_and_spans_in_one_text(spark):
    """Runs apart from spans, and redaction, against plain loops; also over pieces' ends and characters beyond 16 bits."""
    random.seed(9)
    rows = []
    for i in range(60):
        spans, at = [], 0
        for _ in range(random.choice([0, 1, 3, 40])):
            at += random.randint(0, 60)
            spans.append((at, at + random.randint(1, 25), random.choice(pii.KINDS)))
        spans += [(max(0, a - 3), b + random.randint(0, 9), random.choice(pii.KINDS)) for a, b, _ in random.sample(spans, len(spans) // 4)]
        runs, at = [], 0
        for _ in range(random.choice([0, 1, 50])):
            at += random.randint(0, 30)
            runs.append((at, at := at + random.randint(1, 12), "", ""))
        rows.append((i, "".join(random.choice("ab \n\u00e9\u4e2d\U0001f600\ue000") for _ in range(3000)), runs, spans))
    df = spark.createDataFrame(rows, "i int, text string, runs array<struct<start:int,stop:int,s:string,near:string>>, spans array<struct<start:int,stop:int,kind:string>>")
    kinds = [F.expr(f"transform(filter(spans, s -> s.kind = '{k}'), s -> struct(s.start, s.stop))").alias(k) for k in pii.KINDS]
    out = df.select("*", *kinds).select("i", pii.apart(F.col("runs"), F.col("spans")).alias("free"), pii.redacted(F.col("text"), pii.KINDS).alias("done")).collect()
    for r in out:
        _, text, runs, spans = rows[r.i]
        assert [tuple(c) for c in r.free] == [c for c in runs if not any(a < c[1] and c[0] < b for a, b, _ in spans)]
        done, at = "", 0
        for a, b, kind in sorted(spans):
            done += text[at:a] + f"<{kind}>" if a >= at else ""
            at = max(at, b)
        assert r.done == done + text[at:]


def test_many_spans_and_many_runs_of_one_text(spark):
    """A text of more than 1 MB with 50,000 spans and 50,000 runs is found and redacted in about a minute; by pairs it takes an hour."""
    text = "".join(f"u{i}@ex.org x{i}y " for i in range(50_000))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    found = pii.find_personal_data(df).collect()[0]
    assert time.time() - start < 90 and len(found.email) == 50_000
    start = time.time()
    done = pii.without_personal_data(df).collect()[0].text
    assert time.time() - start < 90 and done.startswith("<email> ") and done.count("<email>") == 50_000
