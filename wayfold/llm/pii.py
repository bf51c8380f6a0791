"""Personal data by weak supervision. DataFrame functions only.

Base spans are what fixed patterns and checks give. Beyond them, every run
that holds a digit is a candidate, and regex, gazetteer and context labelers
vote on it or abstain. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; the posteriors it gives train
a logistic span classifier on the shape of candidates, which decides. The
driver sees counts by pattern only, whose number the labelers and features
bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import id_and_text, written

OPEN, CLOSE, NEITHER = "", "", "�"
SPANS = "array<struct<start:int,stop:int,s:string,near:string>>"
KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["secret", "number"]
#: Code points before a candidate that context labelers see.
NEAR = 28
#: Redaction cuts a text into pieces of 2^10 code points.
PIECE_BITS = 10

#: Patterns as given. A run that a match could start in is entered at its start, or where the last match ended, and never
#: given back: the matches are the same and long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"

# Words that stand before personal data, in English, French, German and Spanish.
GAZETTEER = """
    account address api auth bearer birth card cell clave code contact contraseña correo credential credit email geheim geboren
    handy iban ip key konto kontonummer login mail mobile mot passe passport passwd password passwort phone pin pwd
    schlüssel secret social ssn tarjeta tel telefon telefono teléfono telephone téléphone token user
""".split()


def marked_spans(text: Column, pattern: str) -> Column:
    """(start, stop, s, near) of each match, in code points: matches are put between two marks, and lengths are added up.

    Pieces between marks go in rows of about the square root of their number,
    so that adding to an array, which copies it, stays cheap.
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)
    return F.element_at(F.transform(F.array(pieces), _spans_of_pieces), 1)


def _spans_of_pieces(pieces: Column) -> Column:
    width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int")), lambda i: F.slice(pieces, (i * width + 1).cast("int"), width))
    first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))).cast("array<struct<at:int,tail:string>>")

    def goes_on(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        plain = F.translate(F.array_join(row, ""), CLOSE, "")
        return F.concat(acc, F.array(F.struct((last["at"] + F.length(plain)).alias("at"), F.right(F.concat(last["tail"], F.right(plain, F.lit(NEAR))), F.lit(NEAR)).alias("tail"))))

    def add(acc: Column, piece: Column) -> Column:
        held = piece.contains(CLOSE)
        s = F.substring_index(piece, CLOSE, 1)
        stop = acc["at"] + F.length(s)
        span = F.struct(acc["at"].alias("start"), stop.alias("stop"), s.alias("s"), acc["tail"].alias("near"))
        return F.struct(
            (acc["at"] + F.length(piece) - held.cast("int")).alias("at"),
            F.right(F.concat(acc["tail"], F.right(F.translate(piece, CLOSE, ""), F.lit(NEAR))), F.lit(NEAR)).alias("tail"),
            F.when(held, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    def of_row(start: Column, row: Column) -> Column:
        begin = F.struct(start["at"].alias("at"), start["tail"].alias("tail"), F.array().cast(SPANS).alias("found"))
        # the last start has no row behind it
        return F.when(row.isNull(), F.array().cast(SPANS)).otherwise(F.aggregate(F.coalesce(row, F.array().cast("array<string>")), begin, add)["found"])

    return F.element_at(F.transform(F.array(rows), lambda r: F.flatten(F.zip_with(F.aggregate(r, first, goes_on), r, of_row))), 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def reach_before(stops: Column) -> Column:
    """For each of an array of numbers the greatest of those before it, 0 for the first: by rows of about the square root of their number."""

    def of_rows(rows: Column) -> Column:
        return _let(F.transform(rows, F.array_max), lambda tops: F.flatten(F.transform(rows, lambda row, i: _let(F.greatest(F.lit(0), F.array_max(F.slice(tops, F.lit(1), i))), lambda top: of_row(row, top)))))

    def of_row(row: Column, top: Column) -> Column:
        return F.transform(row, lambda _, j: F.greatest(top, F.array_max(F.slice(row, F.lit(1), j))))

    def of(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), lambda i: F.slice(values, (i * width + 1).cast("int"), width)), of_rows)

    return _let(stops, lambda values: F.when(F.size(values) > 0, of(values)).otherwise(F.array().cast("array<int>")))


def apart(runs: Column, spans: Column) -> Column:
    """The runs, which are in order and don't overlap each other, that overlap none of the spans.

    Both go in order, a run by its end and a span by its start, so the spans before a run are those that start
    before it ends; it overlaps one of them if the farthest end among them lies beyond its start.
    """
    of_span = lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_span"), b["stop"].alias("stop"), F.get(runs, F.lit(-1)).alias("run"))
    of_run = lambda c: F.struct(c["stop"].alias("at"), F.lit(0).alias("is_span"), F.lit(0).alias("stop"), c.alias("run"))
    both = F.sort_array(F.concat(F.transform(spans, of_span), F.transform(runs, of_run)))
    free = lambda e, reach: F.when((e["is_span"] == 0) & (reach <= e["run"]["start"]), e["run"])
    merged = _let(both, lambda events: F.filter(F.zip_with(events, reach_before(F.transform(events, lambda e: e["stop"])), free), lambda c: c.isNotNull()))
    return F.when((F.size(runs) == 0) | (F.size(spans) == 0), runs).otherwise(merged)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        v = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = text.contains(HINTS[kind]) if kind in HINTS else F.lit(True)
    if kind != "email":
        hint &= text.rlike("[0-9]")
    found = F.filter(marked_spans(text, PATTERNS[kind]), lambda c: _valid(kind, c["s"]))
    return F.when(hint, found).otherwise(F.array().cast(SPANS))


# -- labelers and features --------------------------------------------------


def _core(c: Column) -> Column:
    """A candidate without a name before = or : and without quotes and closing marks."""
    bare = F.regexp_replace(c["s"], r"^[^\s=:\"']*+[=:]++", "")
    return F.rtrim(F.ltrim(bare, F.lit("\"'(<[")), F.lit("\"')>],.;:!?"))


def _named(c: Column) -> Column:
    """Whether a known name and = or : stand in the candidate or just before it."""
    name = rf"(?:{'|'.join(GAZETTEER)})[\"']?"
    near = F.lower(c["near"])
    return F.lower(c["s"]).rlike(f"{name}[=:]") | near.rlike(rf"{name}\s*[=:]\s*$") | (near.rlike(rf"{name}\s*$") & c["s"].rlike("^[=:]"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


LABELERS: dict[str, Callable[[Column], Column]] = {
    # regex: key ids, long hexadecimal or mixed strings; plain short numbers
    "key_shape": lambda c: _vote(
        _core(c).rlike(r"^(?:AKIA|ASIA|ghp_|sk-|xox[bap]-)[A-Za-z0-9_-]{8,}$|^(?=[^a-zA-Z]*[a-zA-Z])[0-9a-fA-F]{16,}$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_/+=-]{16,}$"), _core(c).rlike(r"^[0-9]{1,4}$|^[0-9]+(?:st|nd|rd|th|er|e|%)$")
    ),
    # regex: numbers written as accounts, phones and social security numbers are
    "number_shape": lambda c: _vote(
        _core(c).rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^\+?[0-9]{9,19}$|^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|@"), _core(c).rlike(r"^[0-9]{1,2}[:./][0-9]{2}$|^[$€£][0-9.,]+$|^v?[0-9]{1,4}(?:\.[0-9]{1,3}){0,2}$")
    ),
    # gazetteer: a known name, then = or :, in the candidate or just before it
    "named": lambda c: _vote(_named(c), F.length(_core(c)) < 4),
    # context: a gazetteer word among the words before; no such word and few digits
    "context": lambda c: _vote(F.lower(c["near"]).rlike(rf"(?<![a-z])(?:{'|'.join(GAZETTEER)})(?![a-z])"), F.length(_digits(c["s"])) < 4),
    # context: the candidate goes on before or behind as a grouped number does
    "grouped": lambda c: _vote(c["near"].rlike(r"[+(]?[0-9)][ -]$|\+$"), F.lit(False)),
}
FEATURES: dict[str, Callable[[Column], Column]] = {
    **{f"long{n}": (lambda n: lambda c: F.length(_core(c)) >= n)(n) for n in (5, 8, 12, 16, 24)},
    **{f"digits{n}": (lambda n: lambda c: F.length(_digits(c["s"])) >= n)(n) for n in (4, 7, 10)},
    "only_digits": lambda c: _core(c).rlike("^[0-9]+$"),
    "lower": lambda c: _core(c).rlike("[a-z]"),
    "upper": lambda c: _core(c).rlike("[A-Z]"),
    "named": lambda c: c["s"].rlike("[=:]") | c["near"].rlike(r"[=:]\s*[\"']?$"),
    "marks": lambda c: _core(c).rlike(r"[^0-9A-Za-z]"),
}


def _reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 40) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(log odds of personal data, for each labeler the log likelihoods of its votes given yes and no)."""
    n = len(LABELERS)
    posterior = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v >= 0 for v in p)) for p in counts}
    prior, tables = 0.5, []
    for _ in range(rounds):
        yes = sum(posterior[p] * c for p, c in counts.items())
        total = sum(counts.values())
        prior = (yes + 1) / (total + 2)
        tables = []
        for j in range(n):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, c in counts.items():
                seen[p[j]][0] += posterior[p] * c
                seen[p[j]][1] += (1 - posterior[p]) * c
            # a labeler's yes is never taken for a no
            table = {v: (math.log(a / (yes + 3)), math.log(b / (total - yes + 3))) for v, (a, b) in seen.items()}
            table[1] = (table[1][0], min(table[1]))
            table[0] = (min(table[0]), table[0][1])
            tables.append(table)
        odds = math.log(prior / (1 - prior))
        posterior = {p: 1 / (1 + math.exp(-max(-30, min(30, odds + sum(t[v][0] - t[v][1] for t, v in zip(tables, p, strict=True)))))) for p in counts}
    return math.log(prior / (1 - prior)), tables


def _logistic(rows: list[tuple[tuple[bool, ...], float, int]], rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Weights (the constant last) by gradient ascent over feature patterns with their mean posterior and count."""
    weights = [0.0] * (len(FEATURES) + 1)
    total = sum(c for *_, c in rows)
    for _ in range(rounds):
        slope = [-0.001 * w for w in weights]
        for p, target, c in rows:
            z = weights[-1] + sum(w for w, on in zip(weights, p, strict=False) if on)
            error = (target - 1 / (1 + math.exp(-max(-30, min(30, z))))) * c / total
            slope[-1] += error
            for k, on in enumerate(p):
                if on:
                    slope[k] += error
        weights = [w + rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _classifier(candidates: DataFrame) -> list[float]:
    """The span classifier's weights, from a table with a column c of candidates."""
    c = F.col("c")
    voted = candidates.select(*(f(c).cast("int").alias(f"v_{k}") for k, f in LABELERS.items()), *(F.coalesce(f(c), F.lit(False)).alias(f"f_{k}") for k, f in FEATURES.items()))
    votes = [f"v_{k}" for k in LABELERS]
    features = [f"f_{k}" for k in FEATURES]
    grouped = written(voted.groupBy(*votes, *features).count(), "votes")
    counts = {tuple(r[v] for v in votes): r["n"] for r in grouped.groupBy(*votes).agg(F.sum("count").alias("n")).collect()}
    if not counts:
        return [0.0] * len(features) + [-30.0]
    prior, tables = _reliabilities(counts)
    odds = F.lit(prior)
    for v, table in zip(votes, tables, strict=True):
        odds += reduce(lambda w, x: w.when(F.col(v) == x, F.lit(table[x][0] - table[x][1])), (1, 0), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(table[-1][0] - table[-1][1]))
    posterior = 1 / (1 + F.exp(-odds))
    learnt = grouped.groupBy(*features).agg((F.sum(posterior * F.col("count")) / F.sum("count")).alias("p"), F.sum("count").alias("n")).collect()
    return _logistic(sorted((tuple(r[f] for f in features), r["p"], r["n"]) for r in learnt))


def _accepted(c: Column, weights: list[float]) -> Column:
    return reduce(lambda z, f: z + F.when(f[0](c), F.lit(f[1])).otherwise(F.lit(0.0)), zip(FEATURES.values(), weights, strict=False), F.lit(weights[-1])) >= 0


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: arrays of spans (start, stop; code points, stop exclusive) by kind.

    email, ip, card and phone hold the base spans; secret and number what the
    classifier adds: of runs without white space that hold a digit and don't
    overlap a base span. keep_text adds the text itself, with the columns named
    in keep.

    Null and empty texts have no spans; repeated rows give repeated results;
    null ids stay null; an empty table gives an empty one; other columns are
    not read. Private-use code points U+E000 and U+E001 in a text count as any
    other character that no pattern takes. Without any candidate nothing is added.
    """
    source = docs.select(F.struct(*(F.col(k) for k in keep if k != text_col)).alias("kept"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) if keep else id_and_text(docs, id_col, text_col)
    text = F.coalesce(F.when(F.col("text").contains(OPEN) | F.col("text").contains(CLOSE), F.translate("text", OPEN + CLOSE, NEITHER * 2)).otherwise(F.col("text")), F.lit(""))
    source = source.withColumn("clean", text)
    clean = F.col("clean")
    runs = F.when(clean.rlike("[0-9]"), marked_spans(clean, CANDIDATE)).otherwise(F.array().cast(SPANS))
    bare = lambda spans: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))
    found = source.select(*(["kept"] if keep else []), "doc_id", *(["text"] if keep_text else []), *(bare(base_spans(clean, k)).alias(k) for k in KINDS), runs.alias("runs"))
    found = written(found, "spans")
    free = apart(F.col("runs"), F.concat(*KINDS))
    weights = _classifier(found.select(F.explode("runs").alias("c")))
    added = F.filter(free, lambda c: _accepted(c, weights) & (F.length(_core(c)) > 0))
    numeric = lambda c: ~_core(c).rlike("[A-Za-z]")

    out = found.withColumn("added", added)
    out = out.withColumn("secret", F.transform(F.filter("added", lambda c: ~numeric(c)), _span)).withColumn("number", F.transform(F.filter("added", numeric), _span))
    return out.drop("runs", "added")


def _span(c: Column) -> Column:
    """The span of a candidate's core."""
    core = _core(c)
    start = (c["start"] + F.greatest(F.instr(c["s"], core) - 1, F.lit(0))).cast("int")
    return F.struct(start.alias("start"), (start + F.length(core)).cast("int").alias("stop"))


def without_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with every span of their text replaced by its kind; other columns stay as they are."""
    found = find_personal_data(docs, id_col, text_col, keep_text=True, keep=docs.columns)
    columns = [redacted(F.col("text"), KINDS + EXTRA).alias(c) if c == text_col else F.col(f"kept.{c}").alias(c) for c in docs.columns]
    return found.select(*columns)


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans of these kinds, in order, joined by commas."""
    parts = [F.transform(F.array_sort(k), (lambda k: lambda c: F.concat_ws(":", F.lit(k), c["start"], c["stop"]))(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def redacted(text: Column, kinds: list[str]) -> Column:
    """The text with each span replaced by its kind in angle brackets; a span that overlaps an earlier one goes into it."""
    spans = F.array_sort(F.concat(*(F.transform(k, (lambda k: lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit(k).alias("kind")))(k)) for k in kinds)))
    size = F.length(text)

    def between(pieces: Column, gap: Column) -> Column:
        """The text of a gap, from the pieces that it touches: a position in a long text is found by counting from its start."""
        first = F.shiftright(gap["start"], PIECE_BITS)
        near = F.array_join(F.slice(pieces, first + 1, F.shiftright(gap["stop"] - 1, PIECE_BITS) - first + 1), "")
        return F.when(gap["stop"] > gap["start"], F.substr(near, gap["start"] % (1 << PIECE_BITS) + 1, gap["stop"] - gap["start"])).otherwise("")

    def of(spans: Column) -> Column:
        gap = lambda s, reach: F.struct(reach.alias("start"), s["start"].alias("stop"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("mark"))
        stops = F.transform(spans, lambda s: s["stop"])
        gaps = F.filter(F.zip_with(spans, reach_before(stops), gap), lambda g: g["stop"] >= g["start"])
        last = F.struct(F.array_max(stops).alias("start"), size.alias("stop"), F.lit("").alias("mark"))
        return _let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{1 << PIECE_BITS}}})"), F.lit(1)), lambda pieces: F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda g: F.concat(between(pieces, g), g["mark"])), ""))

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, of))
