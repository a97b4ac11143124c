"""Personal data by bootstrapped contextual extraction.

One scan finds the base entities of four kinds and, beside them, every token that looks like an
identifier, with the words around it. Seeds are base entities, and tokens in the formats of secrets.
A lexical pattern is the words around an identifier: the two before it, one before, or one on each
side. Patterns and instances form a bipartite graph, which Spark scores in turns: a pattern is as
good as the share of its instances that carry a label, an instance as sure as the patterns that find
it; sure ones take the label and are seeds of the next turn, in all their other contexts. Patterns that
are confident at the end name identifiers that no base rule knows. Only counts per pattern and labels
per instance move between turns.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, clear, discard, mark, records, resting, saved, ship, tune

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Kinds that spans may have: those of base entities, and one that only patterns add.
SPAN_KINDS = (*KINDS, "secret")
#: Turns at most; they end when no instance takes a label.
TURNS = 5
#: A pattern is used if this share of its distinct instances has its label, and this many do.
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 3
#: Patterns from this share on count towards an instance; together they label it from this belief on
#: (one chance in so many that all are wrong, were they independent).
LEAST_SHARE = 0.5
MIN_BELIEF = 0.9

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does; runs without the rest are taken whole.
_IP = re.compile(r"[0-9]++(?:(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))?")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may be an identifier: groups of digits, 7 to 19 in all, with spaces, dots, hyphens or
#: parentheses between them; at least six characters, four of them digits, in one token; or a local
#: part and a host that are spelled out.
_DIGITS = re.compile("[0-9]+")
_GROUPED = re.compile(r"[0-9]++(?:[\x20().-]{1,3}[0-9]++)+(?![A-Za-z])")
_TOKEN = re.compile("[A-Za-z0-9._/+-]+")
_TOKEN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/+-")
_ALPHANUMERIC = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{1,40}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,40}(?:(?: ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]{1,20}){1,3}")
_SPELLED_DOT = re.compile(r"dot ?[\]) ]")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Formats of secrets: digests in hexadecimal, and keys with the prefixes that large services publish.
_SECRET = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|A(?:KI|SI)A[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}|[prs]k_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)"
)
#: Words before a digest that is public: it is no seed there.
_PUBLIC = frozenset("blob build checksum commit digest etag fingerprint hash md integrity revision sha sum tree uuid version".split())

_SCAN = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string"
_SEEN = "array<struct<start:int,end:int,kind:string,base:boolean,instance:string,patterns:array<string>>>"


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run of its characters before an @."""
    at, done = t.find("@"), 0
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_entities(t: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = list(emails(t))
    if _DIGITS.search(t):
        if "." in t:
            out["ip"] = [m.span() for m in _IP.finditer(t) if m[1] and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in t:
            out["phone"] = [m.span() for m in _PHONE.finditer(t) if 10 <= len(digits_of(m[0])) <= 15]
    return out


def around(t: str, a: int, b: int) -> list[str]:
    """Context patterns: the two words before, and one word on each side; lower-cased letters of
    the same line, with the punctuation that leads up to the entity."""
    left = t[max(0, a - 60) : a].rsplit("\n", 1)[-1].lower()
    right = t[b : b + 30].split("\n", 1)[0].lower()
    before, after = _LETTERS.findall(left), _LETTERS.findall(right)
    lead = left[len(left.rstrip(" :=#\"'-")) :].strip()
    found = []
    if len(before) > 1:
        found.append(f"{before[-2]} {before[-1]} {lead}>")
    if before and lead:
        found.append(f"{before[-1]} {lead}>")
    if before and after:
        found.append(f"{before[-1]} {lead}> {after[0]}")
    return found


def grouped(t: str) -> Iterator[tuple[int, int]]:
    """Groups of digits that no letter or digit touches, with a leading + or parenthesis."""
    done = 0
    for run in _DIGITS.finditer(t):
        a = run.start()
        if a < done:
            continue
        leads = [a - len(x) for x in ("(+", "+", "(", "") if t.endswith(x, done, a)]
        start = next((x for x in leads if not x or t[x - 1] not in _ALPHANUMERIC), None)
        m = _GROUPED.match(t, a) if start is not None else None
        if m:
            done = m.end()
            if 7 <= len(digits_of(m[0])) <= 19:
                yield start, done


def tokens(t: str) -> Iterator[tuple[int, int]]:
    """Tokens of six characters or more, at least four of them digits."""
    done = 0
    for run in _DIGITS.finditer(t):
        a = run.start()
        if a < done:
            continue
        while a > done and t[a - 1] in _TOKEN_CHARACTERS:
            a -= 1
        done = _TOKEN.match(t, a).end()
        token = t[a:done].rstrip("._/+-")
        start = done - len(t[a:done].lstrip("._/+-"))
        if a + len(token) - start >= 6 and len(digits_of(token)) >= 4:
            yield start, a + len(token)


def looks_personal(t: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like stretches that no base entity touches."""
    edges = sorted(taken)
    starts = [a for a, _ in edges]
    reach = [0]  # the furthest end of the entities so far
    for _, b in edges:
        reach.append(max(reach[-1], b))
    free = lambda a, b: reach[bisect.bisect_left(starts, b)] <= a
    groups = [g for g in grouped(t) if free(*g)]
    yield from groups
    heads = [a for a, _ in groups]
    for a, b in tokens(t):
        i = bisect.bisect_right(heads, a) - 1
        if free(a, b) and not (i >= 0 and b <= groups[i][1]):
            yield a, b
    if "at" in t and _SPELLED_DOT.search(t):
        yield from (m.span() for m in _SPELLED.finditer(t) if free(*m.span()))


def instance_of(s: str) -> str:
    """What makes two stretches one identifier: digits alone where there are no letters."""
    digits = digits_of(s)
    plain = digits if digits and not _LETTERS.search(s) and "." not in s else s.lower()
    return hashlib.md5(plain.encode()).hexdigest()


def seed_kind(t: str, a: int, b: int, near: list[str]) -> str | None:
    """The kind of a candidate that is a seed by its format."""
    return "secret" if b - a >= 20 and _SECRET.fullmatch(t, a, b) and not any(w in _PUBLIC for p in near[:2] for w in p.split()) else None


def span_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    order = sorted((a, KINDS.index(k), b) for k in KINDS for a, b in spans[k])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in order)


@resting
def scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_SCAN)
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = schema.append(pa.field("seen", pa.list_(seen)))
    for b in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        for uid, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = text or ""
            spans = base_entities(t)
            base = span_text(spans)
            found = [(a, e, k) for k in KINDS for a, e in spans[k]]
            found += [(a, e, None) for a, e in looks_personal(t, [(a, e) for a, e, _ in found])]
            near = []
            for a, e, kind in found:
                patterns = around(t, a, e)
                near.append({"start": a, "end": e, "kind": kind or seed_kind(t, a, e, patterns), "base": kind is not None, "instance": instance_of(t[a:e]), "patterns": patterns})
            for name, value in zip(rows, (uid, doc, *(len(spans[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, near), strict=True):
                rows[name].append(value)
        yield records(rows, schema)


def scored(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that count, given the labels so far. Counts are
    combined before they are shuffled, so a pattern with a third of all edges fills no task."""
    counts = edges.join(labels, "instance", "left").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("best")
    sums = counts.groupBy("pattern").agg(F.sum("n").alias("instances"), best).where(F.col("best.n") >= MIN_SEEDS)
    return sums.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.n") / F.col("instances")).alias("confidence")).where(F.col("confidence") >= LEAST_SHARE)


def bootstrap(edges: DataFrame, seeds: DataFrame, turns: int = TURNS) -> DataFrame:
    """Patterns (pattern, kind, confidence) from distinct (pattern, instance) edges and the
    labels (instance, kind) of seeds. A turn labels the instances that a confident pattern finds, or that
    several find which are nearly so; patterns below LEAST_SHARE label nothing, so doubtful contexts do not
    raise each other."""
    labels, patterns = saved(seeds, "labels"), None
    for turn in range(turns):
        if patterns is not None:
            discard(patterns)
        patterns = saved(scored(edges, labels), "patterns")
        if turn + 1 == turns:
            break
        unlabelled = edges.join(labels, "instance", "left_anti")
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        beliefs = unlabelled.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("belief"), F.max("confidence").alias("best"))
        sure = beliefs.where((F.col("best") >= MIN_CONFIDENCE) | (F.col("belief") >= MIN_BELIEF))
        new = sure.groupBy("instance").agg(F.max(F.struct("belief", "kind"))["kind"].alias("kind"))
        more = saved(new, "labels")
        if more.isEmpty():
            discard(more)
            break
        following = saved(labels.unionByName(more), "labels")
        discard(labels, more)
        labels = following
    discard(labels)
    return patterns


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Base entities are leftmost non-overlapping matches a kind; a match that fails its check is
    dropped and not tried again elsewhere. ``spans`` lists them and what confident patterns found
    (``n_found`` of them; these may also be of the kind secret), as kind:start:end by start, then
    kind, in code points. Null text counts as empty. Null ids,
    repeated rows and texts of any length are rows like any others; an empty table gives an empty
    result; extra columns are ignored.
    """
    tune(docs.sparkSession)
    began = mark()
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = saved(own.mapInArrow(scan_texts, f"{_SCAN}, seen {_SEEN}"), "scan")
    seen = rows.select("uid", F.explode("seen").alias("s")).select("uid", "s.*")
    edges = saved(seen.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    patterns = bootstrap(edges, seen.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")))
    good = patterns.where(F.col("confidence") >= MIN_CONFIDENCE).withColumnRenamed("kind", "found_kind")
    clear(docs.sparkSession, began, (rows, patterns))
    new = seen.where("not base").select("uid", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    best = new.groupBy("uid", "start", "end").agg(F.max(F.struct("confidence", "found_kind")).alias("b")).select("uid", F.struct("start", "end", F.col("b.found_kind").alias("kind")).alias("span"))
    found = best.groupBy("uid").agg(F.collect_list("span").alias("added"))
    base = F.transform(F.array_remove(F.split("base_spans", ","), ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"), F.split(x, ":")[0].alias("kind")))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in SPAN_KINDS]), k)
    every = F.array_sort(F.transform(F.concat(base, F.col("added")), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.drop("seen").join(found, "uid", "left")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("added").isNull(), F.col("base_spans")).otherwise(joined).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
    )
