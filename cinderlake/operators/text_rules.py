"""Rules over free text: one scan per text, one row per finding.

A text with its label is searched once, by one automaton for all phrases, words and
marked characters; the scan gives a bit mask of what occurs.  Evidence is built from the
mask, for set bits only, and only where findings are asked for: trust, counts and
signals read the mask alone.  Findings of a text are an array in check order, which
``inline`` turns into rows.  Everything stays in one stage without a shuffle.  The label
is searched by the rules for injection, invisible characters and terminal escapes as
well as the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import corpora
from ..functions import text as T
from ..schemas import rank

FINDINGS = "array<struct<severity:string,category:string,message:string,evidence:string,check_ord:int,phrase_ord:int>>"
#: Severity, category, message and check of each list of phrases.
PHRASES = [
    ("HIGH", "prompt-injection", "instruction-injection phrase", 0, corpora.INJECTION),
    ("MEDIUM", "tool-poisoning", "phrase that steers the model", 1, corpora.COERCION),
]
# Bits of a mask: injection and coercion phrases, capability words, then single marks.
_INJECTION, _COERCION, _CAPABILITY = 0, len(corpora.INJECTION), len(corpora.INJECTION) + len(corpora.COERCION)
_PUNYCODE = _CAPABILITY + len(corpora.CAPABILITY)
_TERMINAL, _HIDDEN = _PUNYCODE + 1, _PUNYCODE + 2
_searched: list = []


def _bits(first: int, n: int) -> int:
    return ((1 << n) - 1) << first


def _class(pattern: str) -> list[int]:
    """The code points of a character class."""
    spans = re.findall(r"\\x\{([0-9A-F]+)\}(?:-\\x\{([0-9A-F]+)\})?", pattern)
    return [c for a, b in spans for c in range(int(a, 16), int(b or a, 16) + 1)]


def _searches():
    """The automaton of all words (with the bit, and whether the label counts), and the bits of marked characters."""
    if not _searched:
        import ahocorasick

        words = [(x, i, True) for i, x in enumerate(corpora.INJECTION + corpora.COERCION)]
        words += [(x, _CAPABILITY + i, False) for i, x in enumerate(corpora.CAPABILITY)] + [("xn--", _PUNYCODE, False)]
        found = ahocorasick.Automaton()
        for word, bit, everywhere in words:
            found.add_word(word, (1 << bit, everywhere))
        found.make_automaton()
        _searched.append((found.iter, {c: 1 << bit for bit, x in ((_TERMINAL, corpora.TERMINAL), (_HIDDEN, corpora.HIDDEN)) for c in _class(x)}))
    return _searched[0]


@F.arrow_udf(LongType())
def scanned(lows: pa.Array, sizes: pa.Array) -> pa.Array:
    """Mask of a lower-cased text and label; ``sizes``: characters of the text alone."""
    search, chars = _searches()
    masks = [m for b, o in T.buffers(lows) for m in T.holding(b, o, chars).tolist()]
    for i, (low, size) in enumerate(zip(lows.to_pylist(), sizes.to_pylist())):
        for end, (bit, everywhere) in search(low):
            if everywhere or end < size:
                masks[i] |= bit
    return pa.array(masks, pa.int64())


def finding(severity: str | Column, category: str, message: str | Column, evidence: Column | None, check: int, phrase: int = 0) -> Column:
    return F.struct(
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(category).alias("category"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"),
        F.lit(check).alias("check_ord"),
        F.lit(phrase).alias("phrase_ord"),
    )


def with_mask(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``_desc, _name`` (without nulls), ``_basis`` (the text, then the words of the label) and its ``_mask``."""
    return with_masks(df, {"": (text, label)})


def with_masks(df: DataFrame, pairs: dict[str, tuple[str, str]], beside: dict[str, Column] | None = None) -> DataFrame:
    """``with_mask`` of several texts and labels; what is added for a pair ends in its key.

    ``beside``: more columns.  A task holds a Python worker for each projection with Python
    functions of one kind, so all of these are in one.
    """
    df = T.once(df, **{f"{c}{k}": F.coalesce(F.col(x), F.lit("")) for k, pair in pairs.items() for c, x in zip(("_desc", "_name"), pair)})
    df = T.once(df, **{f"_words{k}": F.translate(f"_name{k}", "_-.", "   ") for k in pairs}, **{f"_low{k}": F.lower(f"_desc{k}") for k in pairs})
    masks = {f"_mask{k}": scanned(F.concat_ws(" ", f"_low{k}", F.lower(f"_words{k}")), F.length(f"_low{k}")) for k in pairs}
    bases = {f"_basis{k}": F.concat_ws(" ", f"_desc{k}", f"_words{k}") for k in pairs}
    return df.withColumns(bases | masks | (beside or {})).drop(*[f"{c}{k}" for c in ("_words", "_low") for k in pairs])


def _has(first: int, n: int = 1, mask: str = "_mask") -> Column:
    return F.col(mask).bitwiseAND(F.lit(_bits(first, n))) != 0


def _held(first: int, words: list[str]) -> Column:
    """Of a list of words, as structs of place and word, those whose bits are set, in list order."""
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("word"), F.lit(1 << first + i).cast("long").alias("bit")) for i, w in enumerate(words)])
    return F.filter(listed, lambda w: F.col("_mask").bitwiseAND(w["bit"]) != 0)


def phrase_findings() -> Column:
    """A finding for each injection phrase, then for each coercion phrase, that occurs."""
    def of_list(severity: str, category: str, what: str, check: int, phrases: list[str], first: int) -> Column:
        def made(w: Column) -> Column:
            found = finding(severity, category, F.concat(F.lit(f'{what}: "'), w["word"], F.lit('"')), T.snippet(F.col("_basis"), w["word"]), check)
            return found.withField("phrase_ord", w["i"])

        return F.when(_has(first, len(phrases)), F.transform(_held(first, phrases), made).cast(FINDINGS)).otherwise(F.array().cast(FINDINGS))

    out = [of_list(*p, first) for p, first in zip(PHRASES, (_INJECTION, _COERCION))]
    return F.concat(*out)


def mark_rules(image: Column, blob: Column) -> list[Column]:
    """Of invisible characters, terminal escapes, ways out, long encoded runs and capabilities."""
    char = T.hidden_char(F.concat_ws(" ", "_name", "_desc"))
    words = F.array_join(F.transform(_held(_CAPABILITY, corpora.CAPABILITY), lambda w: w["word"]), ", ")
    return [
        F.when(_has(_HIDDEN), finding("HIGH", "hidden-unicode", F.concat(F.lit("invisible character U+"), T.code_point(char)), None, 2)),
        F.when(_has(_TERMINAL), finding("HIGH", "ansi-escape", "terminal control sequence", None, 3)),
        F.when(_has(_PUNYCODE), finding("HIGH", "exfil-sink", "punycode domain, possibly a homograph", None, 4)),
        F.when(image.isNotNull(), finding("MEDIUM", "exfil-sink", "markdown image at an external URL", image, 5)),
        F.when(blob.isNotNull(), finding("LOW", "encoded-blob", "long encoded run", blob, 6)),
        F.when(_has(_CAPABILITY, len(corpora.CAPABILITY)), finding("LOW", "capability", "powerful capabilities are mentioned", words, 7)),
    ]


def with_findings(df: DataFrame, text: str = "text", label: str = "label", extra: list[Column] | None = None) -> DataFrame:
    """Adds ``findings``, the array of a text's findings in check order."""
    columns = df.columns
    df = with_mask(df, text, label).withColumn("_blob", T.encoded_run(F.col("_desc")))
    df = T.once(df, _image=T.image_url(F.col("_desc")))
    rules = F.array_compact(F.array(*mark_rules(F.col("_image"), F.col("_blob")), *(extra or [])))
    return T.once(df, findings=F.concat(phrase_findings(), rules.cast(FINDINGS))).select(*columns, "findings")


def with_counts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``high, medium, low``: how many findings a text has, without making them."""
    columns = df.columns
    df = with_mask(df, text, label)
    number = lambda first, n=1: F.bit_count(F.col("_mask").bitwiseAND(F.lit(_bits(first, n))))
    image, blob = T.has_image_url(F.col("_desc")), T.encoded_run(F.col("_desc")).isNotNull()
    high = number(_INJECTION, len(corpora.INJECTION)) + number(_PUNYCODE, 3)
    medium = number(_COERCION, len(corpora.COERCION)) + image.cast("int")
    low = _has(_CAPABILITY, len(corpora.CAPABILITY)).cast("int") + blob.cast("int")
    return df.select(*columns, high.alias("high"), medium.alias("medium"), low.alias("low"))


def with_signals(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Adds ``signals``: the distinct (rank, category) of a text's findings, without making them."""
    return with_all_signals(df, {"signals": (text, label)})


def with_all_signals(df: DataFrame, pairs: dict[str, tuple[str, str]], beside: dict[str, Column] | None = None) -> DataFrame:
    """``with_signals`` of several texts and labels, in columns named by the keys.  ``beside``: more columns, made in the same projection."""
    columns = [*df.columns, *(beside or {})]
    df = with_masks(df, pairs, {f"_run{k}": T.encoded_run(F.col(f"_desc{k}")) for k in pairs} | (beside or {}))
    return df.select(*columns, *[_signals(k).alias(k) for k in pairs])


def _signals(key: str) -> Column:
    has = lambda first, n=1: _has(first, n, f"_mask{key}")
    signal = lambda severity, category: F.struct(F.lit(corpora.SEVERITIES.index(severity)).alias("rank"), F.lit(category).alias("category"))
    found = [F.when(has(first, len(p[4])), signal(p[0], p[1])) for p, first in zip(PHRASES, (_INJECTION, _COERCION))]
    found += [F.when(has(_HIDDEN), signal("HIGH", "hidden-unicode")), F.when(has(_TERMINAL), signal("HIGH", "ansi-escape")), F.when(has(_PUNYCODE), signal("HIGH", "exfil-sink"))]
    found += [F.when(T.has_image_url(F.col(f"_desc{key}")), signal("MEDIUM", "exfil-sink")), F.when(F.col(f"_run{key}").isNotNull(), signal("LOW", "encoded-blob"))]
    found += [F.when(has(_CAPABILITY, len(corpora.CAPABILITY)), signal("LOW", "capability"))]
    return F.array_compact(F.array(*found))


def rows_of(df: DataFrame, keys: list[str], tool: Column) -> DataFrame:
    """One row per finding, with its rank and order."""
    out = df.select(*keys, tool.alias("tool"), F.inline("findings"))
    return out.withColumn("severity_rank", rank(F.col("severity"), corpora.SEVERITIES))


def scan_text(df: DataFrame, keys: list[str], text: str = "text", label: str = "label") -> DataFrame:
    """Findings of free texts.  An empty label leaves ``tool`` null."""
    scanned = with_findings(df, text, label)
    return rows_of(scanned, keys, F.nullif(F.coalesce(F.col(label), F.lit("")), F.lit("")))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in corpora.SEVERITIES])


def text_severities(df: DataFrame, *keys: str) -> DataFrame:
    """``severity_counts`` of the findings of free texts, from their masks; keys without findings are left out."""
    sums = with_counts(df).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("high", "medium", "low")])
    return sums.where("high + medium + low > 0").withColumn("info", F.lit(0).cast("long"))


def text_trust(df: DataFrame, key: str) -> DataFrame:
    """``trust_collapse`` of the findings of free texts, from their masks."""
    sums = with_counts(df).groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in ("high", "medium", "low")])
    worst = F.when(F.col("high") > 0, 0).when(F.col("medium") > 0, 1)
    return sums.select(key, (F.col("high") + F.col("medium") + F.col("low")).alias("n_findings"), trust_of(worst).alias("verdict"), worst.isNotNull().alias("flagged"))


def trust_of(worst_rank: Column) -> Column:
    """Any HIGH: AVOID; any MEDIUM: REVIEW; else GREEN."""
    return F.when(worst_rank == 0, "AVOID").when(worst_rank == 1, "REVIEW").otherwise("GREEN")


def trust_collapse(subjects: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """A verdict for each subject, also for those without findings."""
    worst = findings.groupBy(key).agg(F.min("severity_rank").alias("worst"), F.count("*").alias("n_findings"))
    return subjects.select(key).distinct().join(worst, key, "left").select(
        key, F.coalesce("n_findings", F.lit(0)).alias("n_findings"), trust_of(F.col("worst")).alias("verdict"),
        F.coalesce(F.col("worst") <= 1, F.lit(False)).alias("flagged"),
    )


# Skills, scripts and memory

def script_rules(text: Column) -> list[Column]:
    """Tells in a script's text: (condition, severity, category) as findings."""
    low = F.lower(text)
    piped = F.exists(F.split(low, "\n"), lambda x: T.any_of(x, ["curl ", "wget "]) & T.any_of(x, corpora.SKILL_PIPES))
    decoded = T.any_of(low, corpora.DECODERS) & T.any_of(low, corpora.DECODE_SINKS)
    return [
        F.when(T.any_of(low, ["curl ", "wget "]) & piped, finding("HIGH", "remote-exec", "downloads and runs in one line", None, 10)),
        F.when(decoded, finding("HIGH", "obfuscated-exec", "decodes and runs", None, 11)),
        F.when(T.any_of(low, corpora.SECRET_PATHS), finding("HIGH", "secret-access", "touches credential files", None, 12)),
        F.when(T.any_of(low, corpora.ENV_DUMPS), finding("MEDIUM", "env-dump", "reads the whole environment", None, 13)),
        F.when(
            T.any_of(low, corpora.FETCHES) & T.any_of(low, ["http://", "https://"]), finding("MEDIUM", "network-egress", "sends or fetches over the network", None, 14)
        ),
    ]


def frontmatter_rules(front: Column) -> list[Column]:
    low = F.lower(front)
    return [
        F.when(F.contains(low, F.lit("allowed-tools")) & T.any_of(low, ["bash", "*"]), finding("MEDIUM", "broad-tools", "grants broad tools", None, 20)),
        F.when(
            F.contains(low, F.lit("permission")) & T.any_of(low, ["skip", "bypass", "accept", "auto"]), finding("HIGH", "auto-approve", "skips permission prompts", None, 21)
        ),
    ]


def memory_rules(text: Column) -> list[Column]:
    low = F.lower(text)
    poisoned = T.any_of(low, ["curl ", "wget "]) & T.any_of(low, corpora.MEMORY_PIPES) | T.any_of(low, ["rm -rf ", "eval("])
    return [
        F.when(poisoned, finding("HIGH", "poisoned-memory", "a stored record runs commands", None, 30)),
        F.when(~poisoned & T.any_of(low, corpora.MEMORY_STEER), finding("MEDIUM", "actionable-memory", "a stored record gives orders", None, 31)),
    ]


def scan_rules(df: DataFrame, keys: list[str], rules: list[Column], tool: Column | None = None) -> DataFrame:
    scanned = df.withColumn("findings", F.array_compact(F.array(*rules)))
    return rows_of(scanned, keys, F.lit(None).cast("string") if tool is None else tool)
