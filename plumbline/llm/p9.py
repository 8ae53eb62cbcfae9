"""Problem 9: personal information inside free text, by bootstrapped contextual extraction.

One pass over the texts finds candidate places of each kind by loose shapes: number runs, runs of capitalised words,
number-and-street forms, and pairs of words with a sign or a word for @ between. Each candidate names a feature of its
own (the shape of a number, the kind of street, the way a mail address is disguised, the given name) and its left and
right context. Features of places that label themselves are the seeds; Spark then scores the graph between features and
contexts in rounds: a context is worth the mean score of what stands in it, a feature the mean score of where it stands,
and what becomes worth much passes that on, so that papers, street kinds, disguises and names that no seed has are found
through the contexts they share. Contexts of order, booking and item numbers are worth nothing, always.

Null, empty and blank texts hold no mention. Mentions never overlap: one inside a longer one is dropped.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.scratch import cut
from plumbline.sources.tables import spread, table

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
ROUNDS, PRIOR = 3, 1.0
#: Characters in which the two words of a context must stand, and those a mail address may have at most.
CONTEXT, ADDRESS_LENGTH = 40, 254
#: Least scores: of a disguise, of the three parts of a number together, of a street kind, and of the parts of a name.
MAIL, NUMBER, STREET = 0.3, 0.3, 0.25
NAME_GIVEN, NAME_SURNAME, NAME_INITIAL, NAME_CONTEXT = 0.3, 0.05, 0.3, 0.3

_L, _U = r"[^\W\d_]", r"\p{Lu}"
_WORD = rf"{_U}[\p{{L}}\p{{M}}'’]+"
_SUR = rf"{_WORD}(?:-{_WORD})?"
_PART = r"(?:(?:von|van|der|den|de|del|della|di|da|dos|al|el|bin|ben|ter|la|le|zu|af)\s)"
_GAP = r"[  ]"
_MAIL_PLAIN = r"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*\s?[@＠﹫]\s?[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}(?![\w-])"
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@|arroba|ät)\s?[\])}>]\s?|\s(?:at|AT|arroba)\s|\s@\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punto|punkt|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT|punto|punkt|point)\s|\.)"
_MAIL_OTHER = rf"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}\p{{L}}{{2,}}(?![\w-])"
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf)"
_SPELLED = rf"(?i)(?<!\w){_DIGIT}(?:[ ,.-]{{1,2}}{_DIGIT}){{5,}}(?!\w)"
_NUMBER = r"(?<![\w.,/+-])(?:\p{Lu}{1,2}[ -]?)?(?:\+\d|\(\d|\d)(?:\d|[ ./-](?=[\d(])|\(|\) ?(?=\d)|\)[-/](?=\d))*\d(?:-?\p{Lu}{1,2})?(?![\w]|[.,/-]\d)"
_UNIT = r"(?i:,? (?:Apt|Apartment|Suite|Ste|Flat|Unit|Floor|Fl|Room|Rm|No)\.? ?#?\d+[A-Za-z]?|,? #\d+[A-Za-z]?)"
_DIR = r"(?:(?:N|S|E|W|NE|NW|SE|SW)\.? |(?i:North|South|East|West) )"
_STREET = [
    # number, name, kind: "12-B W. Oak Street, Apt 3"
    ("n", rf"(?<![\w.,-])(?P<no>\d{{1,5}}(?:-?[A-Za-z])?) {_DIR}?(?:(?:{_WORD}|\d{{1,3}}(?i:st|nd|rd|th))[ -]){{WORDS}}(?P<kind>{_U}\p{{L}}+)\b\.?(?={_UNIT}|[^\w]|$){_UNIT}?"),
    # the same in small letters, where only these words end a street
    ("n", rf"(?<![\w.,-])(?P<no>\d{{1,5}}(?:-?[A-Za-z])?) (?:(?:[nsew]\.?|north|south|east|west) )?(?:\p{{Ll}}+ |\d{{1,3}}(?:st|nd|rd|th) ){{1,2}}(?P<kind>street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|terrace|way|boulevard|blvd|place|square|close|crescent)\b{_UNIT}?"),
    # kind first: "Calle del Roble 12, 3.º A", "Plaza Roble 3"
    ("k", rf"(?<![\w])(?P<kind>{_U}\p{{L}}+|C/) (?:(?:de|del|de la|de los|de las|della|da|do) )?{_WORD}(?:[ -]{_WORD}){{0,2}},? \d{{1,4}}[a-zA-Z]?(?:, \d{{1,2}}\.?[ºª°o]? ?\p{{Lu}}?(?![\w]))?(?![\w]|[.,]\d)"),
    # number, small kind, name: "12, rue des Chênes"
    ("f", rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?P<kind>\p{{Ll}}+) (?:(?:des?|du|de la|de l['’]|d['’]) ?)?{_WORD}(?:[ -]{_WORD}){{0,2}}"),
    # one word, number: "Eichenweg 12a", "Am Eichenplatz 3"
    ("d", rf"(?<![\w])(?:(?:Am|An der|Auf der|Im|Zum|Zur) )?(?P<kind>{_U}[\p{{L}}-]{{4,}}) \d{{1,4}}(?:[ ]?[a-z])?(?![\w]|[.,]\d)"),
]
_NAMES = [
    ("g", rf"(?<![\p{{L}}\d'’.-])(?P<given>{_WORD}){_GAP}(?:(?P<mid>\p{{Lu}}\.|{_WORD}){_GAP})?{_PART}{{0,2}}(?P<sur>{_SUR})(?![\p{{L}}\d-])"),
    ("i", rf"(?<![\p{{L}}\d'’.-])(?P<mid>\p{{Lu}}\.){_GAP}{_PART}{{0,2}}(?P<sur>{_SUR})(?![\p{{L}}\d-])"),
    ("s", rf"(?<![\p{{L}}\d'’.-]){_PART}{{0,2}}(?P<sur>{_SUR}), (?P<given>{_WORD})(?: \p{{Lu}}\.(?=[\s;,]|$))?(?![\p{{L}}\d-])"),
    ("l", r"(?<==)(?P<given>\p{Ll}[\p{L}\p{M}]+) (?:(?P<mid>\p{L}\.|\p{Ll}+) )??(?P<sur>\p{Ll}[\p{L}\p{M}-]+)(?=;|$|\n)"),
]
#: A street with one, two and three words before its kind: which of them is one, its kind tells.
_STREET_RX = [(k, regex.compile(p.replace("{WORDS}", f"{{{n}}}"))) for k, p in _STREET for n in ((1, 2, 3) if "WORDS" in p else (1,))]
_NAME_RX = [(k, regex.compile(p)) for k, p in _NAMES]
_AT_RX, _LOCAL_RX, _SIGN_RX = regex.compile(_AT), regex.compile(r"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*$"), regex.compile("[@＠﹫]")
_TURNED_RX = regex.compile(r"\p{Lu}[\p{L}\p{M}'’]+, \p{Lu}")
_DIGITS = frozenset(_DIGIT[3:-1].split("|"))
_MAIL_RX, _MAIL2_RX, _NUM_RX, _SPELLED_RX = map(regex.compile, (_MAIL_PLAIN, _MAIL_OTHER, _NUMBER, _SPELLED))
#: Words before a number that make it one of an order, booking, item and the like, which is no case.
_NOT = re.compile(r"\b(order|booking|reservation|invoice|item|coupon|bill|receipt|version|ticket|ref|gate|room|bestellung|rechnung|pedido|factura|commande|facture)\b")
#: The kinds of streets the bootstrapping starts with, by form.
_SEED_STREETS = {"n": {"street", "road", "avenue"}, "k": {"calle"}, "f": {"rue"}, "d": {"straße", "strasse"}}
#: Shapes of numbers that only identity papers have.
_SEED_PAPERS = ("999-99-9999", "99999999A", "99999999-A", "99.999.999-A")
_TAIL = 3  # letters that tell the kind of a one-word street, and of a surname the ending


def _left(t: str, s: int) -> str:
    line = t[max(0, s - CONTEXT) : s]
    line = line[line.rfind("\n") + 1 :]
    if not line.strip():
        return "^"
    glued = "" if line[-1].isspace() else "+"
    two = re.sub(r"\d+", "9", line.lower()).split()[-2:]
    if len(two) == 2 and two[0][-1] in ".!?;":
        two = two[1:]  # what ends a sentence before tells nothing
    return glued + " ".join(two)


def _right(t: str, e: int) -> str:
    line = t[e : e + CONTEXT].split("\n", 1)[0]
    if not line.strip():
        return "$"
    glued = "" if line[0].isspace() else "+"
    return glued + " ".join(re.sub(r"\d+", "9", line.lower()).split()[:2])


def _shape(m: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", m))


def _sur(s: str) -> str:
    s = s.lower()
    return f"{s[:3]}~{s.rsplit('-', 1)[-1][-3:]}"


def _spelled(t: str) -> bool:
    """Whether four words in a row are digits, as there must be inside six that may have other signs around them."""
    w = t.lower().replace(",", " ").replace(".", " ").replace("-", " ").split()
    if sum(map(_DIGITS.__contains__, w)) < 4:
        return False
    run = 0
    for x in w:
        run = run + 1 if x in _DIGITS else 0
        if run == 4:
            return True
    return False


def found_in(t: str) -> Iterator[tuple[str, str, int, int, str, str, str]]:
    """(group, form, start, end, feature, second feature, middle name) of each candidate in `t`."""
    if _SIGN_RX.search(t):
        for m in _MAIL_RX.finditer(t):
            yield "EMAIL", "@", m.start(), m.end(), "@", "", ""
    for a in _AT_RX.finditer(t, overlapped=True):
        # The part before has no blank: start where it starts, instead of trying every place of the text.
        local = _LOCAL_RX.search(t, max(0, a.start() - ADDRESS_LENGTH), a.start())
        m = local and _MAIL2_RX.match(t, local.start())
        if m and (" @ " in m.group() or not _SIGN_RX.search(m.group())):
            style = regex.sub(r"[\w%+-]{2,}(?<!\bat|\bAT|\bdot|\bDOT|\barroba|\bpunto|\bpunkt|\bpoint)", "w", m.group())
            yield "EMAIL", "w", m.start(), m.end(), regex.sub(r"w([.\-]w)*", "w", style), "", ""
    if _spelled(t):
        for m in _SPELLED_RX.finditer(t):
            yield "NUMBER", "w", m.start(), m.end(), "spelled", "", ""
    for m in _NUM_RX.finditer(t):
        s, e = m.span()
        g = m.group()
        n = sum(c.isdigit() for c in g)
        if not 7 <= n + (sum(c.isalpha() for c in g) >= 3) <= 15:
            continue
        if g[0] == "(" and ")" not in g:
            s, g = s + 1, g[1:]
        if regex.fullmatch(r"(19|20)\d\d-\d\d-\d\d([ T].*)?|\d\.\d{7,}", g):
            continue  # dates and fractions
        yield "NUMBER", "9", s, e, _shape(g), "", ""
    for form, rx in _STREET_RX:
        for m in rx.finditer(t, overlapped=form == "k"):
            kind = m.group("kind").lower()
            s, e = m.span()
            if form == "n" and t[e - 1] == "." and not m.group().endswith((" St.", " Rd.", " Ave.")):
                e -= 1
            if form == "n" and t[e - 1] == "." and regex.match(r"\s+\p{Lu}|\s*$", t[e:]):
                e -= 1  # the full stop of the sentence
            yield "ADDRESS", form, s, e, form + ":" + (kind[-_TAIL:] if form == "d" else kind), "", ""
    for form, rx in _NAME_RX:
        if form == "l" and "=" not in t or form == "s" and not _TURNED_RX.search(t):
            continue
        for m in rx.finditer(t, overlapped=True):
            d = m.groupdict()
            given = (d.get("given") or "").lower()
            mid = d.get("mid") or ""
            yield "NAME", form, *m.span(), given, _sur(d["sur"]), "" if mid.endswith(".") else mid.lower()


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, grp, form, s, e, mention, feature, second, mid, lft, rgt) of (key, text); one pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "grp", "form", "s", "e", "mention", "feature", "second", "mid", "lft", "rgt"]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for d, t in zip(b.column("doc").to_pylist(), b.column("t").to_pylist()):
                if not t or d is None:
                    continue
                for g, form, s, e, f, f2, mid in found_in(t):
                    for c, v in zip(rows, (d, g, form, s, e, t[s:e], f, f2, mid, _left(t, s), _right(t, e))):
                        c.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()] + [pa.string()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(rows, types)], names)

    schema = "doc bigint, grp string, form string, s int, e int, mention string, feature string, second string, mid string, lft string, rgt string"
    return cut(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).mapInArrow(run, schema))


def _seed(grp: Column, form: Column, feature: Column) -> tuple[Column, Column]:
    """Score of a feature that labels itself, for the first kind of its group and for IDs; else null."""
    streets = F.lit(False)
    for f, kinds in _SEED_STREETS.items():
        streets = streets | feature.isin(*[f"{f}:{k[-_TAIL:] if f == 'd' else k}" for k in kinds])
    one = (
        F.when((grp == "EMAIL") & (feature == "@"), 1.0).when((grp == "ADDRESS") & streets, 1.0)
        .when((grp == "NUMBER") & feature.startswith("+9"), 1.0).when((grp == "NUMBER") & feature.isin(*_SEED_PAPERS), 0.0)
    )
    two = F.when((grp == "NUMBER") & feature.isin(*_SEED_PAPERS), 1.0).when((grp == "NUMBER") & feature.startswith("+9"), 0.0)
    return one, two


def scored(cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features: grp, kind of feature, feature, n, s1, s2), (contexts: grp, side, ctx, n, s1, s2) after ROUNDS rounds.

    s1 scores the first kind of a group (PHONE of numbers), s2 scores IDs. Everything is counted per distinct
    (feature, context) before it is shuffled.
    """
    ctx = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("lft").alias("ctx")), F.struct(F.lit("r").alias("side"), F.col("rgt").alias("ctx"))))
    feats = F.explode(F.array(F.struct(F.lit("f").alias("which"), F.col("feature").alias("feature")), F.struct(F.lit("s").alias("which"), F.col("second").alias("feature"))))
    e = cand.select("grp", "form", "feature", "second", ctx.alias("c")).select("grp", "form", "c.*", feats.alias("x")).select("grp", "side", "ctx", "form", "x.*").filter("feature <> ''")
    e = cut(e.groupBy("grp", "side", "ctx", "which", "feature").agg(F.count(F.lit(1)).alias("n")))
    one, two = _seed(F.col("grp"), F.col("which"), F.col("feature"))
    not_case = F.col("ctx").rlike(_NOT.pattern) & (F.col("side") == "l") & (F.col("grp") == "NUMBER")
    # The value of a field that says it is a name is one.
    label = (F.col("side") == "l") & (F.col("grp") == "NAME") & F.col("ctx").rlike(r"(^|[ \[\]+])(name|guest)=$|name is$")
    fkey, ckey = ["grp", "which", "feature"], ["grp", "side", "ctx"]
    f = e.groupBy(*fkey).agg(F.sum("n").alias("n")).withColumn("s1", F.coalesce(one, F.lit(0.0))).withColumn("s2", F.coalesce(two, F.lit(0.0)))
    f, c = f.select(*fkey, "s1", "s2"), None
    total = lambda x: F.sum(F.col("n") * F.col(x)) / (F.sum("n") + PRIOR)
    for _ in range(ROUNDS):
        c = e.join(f, fkey).groupBy(*ckey).agg(total("s1").alias("s1"), total("s2").alias("s2"))
        c = cut(c.select(*ckey, F.when(not_case, 0.0).when(label, 1.0).otherwise(F.col("s1")).alias("s1"), F.when(not_case, 0.0).otherwise(F.col("s2")).alias("s2")))
        f = cut(e.join(c, ckey).groupBy(*fkey).agg(total("s1").alias("s1"), total("s2").alias("s2")))
        # Names have labels instead of seeds: what labelled names score is what a name is to score.
        norm = e.filter(label).join(f, fkey).groupBy("grp", "which").agg(total("s1").alias("norm"))  # two rows
        f = f.join(F.broadcast(norm), ["grp", "which"], "left").select(
            *fkey, F.coalesce(one, F.least(F.lit(1.0), F.try_divide("s1", F.coalesce("norm", F.lit(1.0)))), F.lit(0.0)).alias("s1"), F.coalesce(two, F.col("s2")).alias("s2")
        )
    return cut(f), c


def judged(cand: DataFrame) -> DataFrame:
    """`cand` with the scores of its parts: f1, f2 (feature), g1 (second), m1 (middle name), l1, l2, r1, r2 (contexts)."""
    f, c = scored(cand)
    feat = f.filter("which = 'f'").select("grp", "feature", F.col("s1").alias("f1"), F.col("s2").alias("f2"))
    mid = f.filter("which = 'f'").select("grp", F.col("feature").alias("mid"), F.col("s1").alias("m1"))
    sec = f.filter("which = 's'").select("grp", F.col("feature").alias("second"), F.col("s1").alias("g1"))
    left = c.filter("side = 'l'").select("grp", F.col("ctx").alias("lft"), F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    right = c.filter("side = 'r'").select("grp", F.col("ctx").alias("rgt"), F.col("s1").alias("r1"), F.col("s2").alias("r2"))
    out = cand
    for side, key in ((left, "lft"), (right, "rgt"), (feat, "feature"), (sec, "second"), (mid, "mid")):
        out = out.join(side, ["grp", key], "left")
    return out.na.fill(0.0, ["f1", "f2", "g1", "m1", "l1", "l2", "r1", "r2"])


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, kind, s, e, mention) of the accepted places, none overlapping another; s, e count code points."""
    j = judged(candidates(docs, key, text))
    one, two = F.col("f1") + F.col("l1") + F.col("r1"), F.col("f2") + F.col("l2") + F.col("r2")
    veto = F.col("lft").rlike(_NOT.pattern)
    named = F.when(F.col("form") == "i", (F.col("g1") >= NAME_INITIAL) | ((F.col("l1") >= NAME_CONTEXT) & (F.col("g1") >= NAME_SURNAME)))
    named = named.otherwise((F.col("f1") >= NAME_GIVEN) & (F.col("g1") >= NAME_SURNAME) & ((F.col("mid") == "") | (F.col("m1") >= NAME_GIVEN)))
    kind = (
        F.when((F.col("grp") == "EMAIL") & (F.col("f1") >= MAIL), "EMAIL")
        .when((F.col("grp") == "NUMBER") & ~veto & (two > one) & (two >= NUMBER), "ID")
        .when((F.col("grp") == "NUMBER") & ~veto & (one >= NUMBER), "PHONE")
        .when((F.col("grp") == "ADDRESS") & (F.col("f1") >= STREET), "ADDRESS")
        .when((F.col("grp") == "NAME") & named, "NAME")
    )
    a = j.withColumn("kind", kind).filter("kind is not null").groupBy("doc", "s", "e").agg(F.min("kind").alias("kind"), F.min("mention").alias("mention"), F.min("form").alias("form"))
    # "Chef, Ann Miller" isn't "Ann Chef" turned round: a name that goes on behind the comma is one of its own.
    ahead = Window.partitionBy("doc").orderBy("s", F.desc("e"))
    ns, ne = F.lead("s").over(ahead), F.lead("e").over(ahead)
    a = a.withColumn("turned", (F.col("form") == "s") & (F.col("kind") == "NAME") & (ns < F.col("e")) & (ne > F.col("e"))).filter("not coalesce(turned, false)")
    # Within a document, the longer mention first: what starts inside an earlier one goes.
    w = Window.partitionBy("doc").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("before", F.max("e").over(w)).filter("before is null or s >= before").select("doc", "kind", "s", "e", "mention")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, kind, mention: distinct, the mention as it stands in the text."""
    return mentions(_documents(spark, d), "doc_id", "text").select(F.col("doc").alias("doc_id"), "kind", "mention").distinct()


def redacted(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, redacted, n_mentions of every document: each mention replaced by its typed placeholder; null stays null."""
    docs = _documents(spark, d)
    m = mentions(docs, "doc_id", "text").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias("m"))

    @F.pandas_udf("string")
    def fill(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, spans):
            if t is None or m is None:
                out.append(t)
                continue
            parts, at = [], 0
            for x in m:
                parts += [t[at : x["s"]], f"[{x['kind']}]"]
                at = x["e"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    j = docs.join(m, docs["doc_id"] == m["doc"], "left")
    return j.select("doc_id", fill("text", "m").alias("redacted"), F.when(F.col("m").isNull(), 0).otherwise(F.size("m")).alias("n_mentions"))
