"""Names, versions, hosts and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import corpora
from .text import fold_fullwidth

SPEC = r"^(.[^@]*)(?:@(.+))?$"


def spec_name(spec: Column) -> Column:
    return F.nullif(F.regexp_extract(spec, SPEC, 1), F.lit(""))


def spec_version(spec: Column) -> Column:
    return F.nullif(F.regexp_extract(spec, SPEC, 2), F.lit(""))


def spec_valid(spec: Column) -> Column:
    """A name, and a version wherever there is a separator after the first character."""
    return spec_name(spec).isNotNull() & ~F.endswith(F.substr(spec, F.lit(2)), F.lit("@"))


def display_name(name: Column, version: Column) -> Column:
    return F.concat_ws("@", name, version)


def base_name(name: Column) -> Column:
    """Without the scope, in lower case."""
    return F.lower(F.regexp_replace(name, "^@[^/]*/", ""))


def descriptor_name(descriptor: Column) -> Column:
    """name of ``name@range``, with its scope."""
    return F.nullif(F.regexp_extract(descriptor, "^(@?[^@]*)", 1), F.lit(""))


def descriptor_version(descriptor: Column) -> Column:
    return F.nullif(F.regexp_extract(descriptor, "^@?[^@]*@(.*)$", 1), F.lit(""))


def package_skeleton(name: Column) -> Column:
    return fold_fullwidth(F.translate(F.lower(name), *corpora.PACKAGE_FOLD))


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or transposition of neighbours apart."""
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(b, F.lit(1), i - 1), F.substr(b, i + 1, F.lit(1)), F.substr(b, i, F.lit(1)), F.substr(b, i + 2)) == a,
    )
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (a != b) & (F.length(b) >= 2) & swap)


def name_skeleton(name: Column) -> Column:
    wide = "".join(map(chr, range(0xFF41, 0xFF5B)))
    folded = F.translate(name, *corpora.NAME_FOLD)
    return F.translate(folded, wide + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz" * 2)


def name_confusable(name: Column) -> Column:
    """Latin mixed with Cyrillic or Greek, or a fold to plain ASCII that differs from the name."""
    mixed = name.rlike("[A-Za-z]") & name.rlike(r"[\x{0400}-\x{04FF}\x{0370}-\x{03FF}]")
    folded = name_skeleton(name)
    return mixed | ((folded != F.lower(name)) & ~folded.rlike(r"[^\x00-\x7F]"))


def resolved_host(url: Column) -> Column:
    """Host of an http(s) URL in a lockfile, in lower case, else null."""
    h = F.regexp_extract(url, r"^(?:registry\+|sparse\+)?https?://(?:[^/]*@)?([^/:]*)", 1)
    return F.nullif(F.lower(h), F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a URL with or without a scheme, as written, else null."""
    rest = F.regexp_replace(url, "^https?://", "")
    authority = F.regexp_extract(rest, "^([^/]*)", 1)
    host = F.regexp_extract(F.substring_index(authority, "@", -1), "^([^:]*)", 1)
    return F.nullif(host, F.lit(""))


def site(host: Column) -> Column:
    """The last two labels."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def official(host: Column, ecosystem: Column) -> Column:
    out = F.lit(False)
    for eco, hosts in corpora.OFFICIAL_HOSTS.items():
        for h in hosts:
            out = out | ((ecosystem == eco) & ((host == h) | F.endswith(host, F.lit(f".{h}"))))
    return out


def slash_encoded(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("%2F"))


def crates_index_path(name: Column) -> Column:
    low = F.lower(name)
    n = F.length(low)
    return (
        F.when(n == 1, F.concat(F.lit("1/"), low)).when(n == 2, F.concat(F.lit("2/"), low))
        .when(n == 3, F.concat_ws("/", F.lit("3"), F.substr(low, F.lit(1), F.lit(1)), low))
        .otherwise(F.concat_ws("/", F.substr(low, F.lit(1), F.lit(2)), F.substr(low, F.lit(3), F.lit(2)), low))
    )


def card_urls(target: Column) -> Column:
    """Where an agent card may be, in order of preference; null for a target that isn't a host or an https URL."""
    t = F.trim(target)
    host = F.when(F.startswith(t, F.lit("https://")), url_host(t)).when(~F.contains(t, F.lit("/")), t)
    two = F.array(*[F.concat(F.lit("https://"), host, F.lit(f"/.well-known/{f}.json")) for f in ("agent-card", "agent")])
    return F.when((t == "") | F.startswith(t, F.lit("http://")), None).when(F.contains(t, F.lit("/.well-known/")), F.array(t)).when(host.isNotNull(), two)


def _padded(digits: Column) -> Column:
    """A number as text that sorts by value: how many digits it has, then the digits."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def semver_key(version: Column) -> Column:
    """A text that sorts as the version does by SemVer's rules of precedence; null for what is none.

    Missing minor and patch numbers are 0, a leading ``v`` and build data don't count.  Parts of a
    pre-release sort numbers first; a release sorts after all its pre-releases.
    """
    v = F.trim(version)
    pattern = r"^[vV=]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    number = lambda i: _padded(F.coalesce(F.nullif(F.regexp_extract(v, pattern, i), F.lit("")), F.lit("0")))
    pre = F.regexp_extract(v, pattern, 4)
    parts = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), _padded(p))).otherwise(F.concat(F.lit("1"), p)))
    # The mark between parts sorts below every character of a part, so fewer parts sort first.
    return F.when(v.rlike(pattern), F.concat(F.concat_ws(".", number(1), number(2), number(3)), F.when(pre == "", "~").otherwise(F.concat(F.lit("!"), F.array_join(parts, "!")))))


# Other spellings of the parts of a version.
_STAGES = {"alpha": "a", "beta": "b", "c": "rc", "pre": "rc", "preview": "rc"}


def pep440_key(version: Column) -> Column:
    """A text that sorts as the version does by the rules of PEP 440; null for what is none.

    Epoch, release without zeros at its end, then pre-releases (a development release without one
    sorts below them), post-releases and local parts.
    """
    v = F.lower(F.trim(version))
    pattern = (
        r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(alpha|a|beta|b|preview|pre|c|rc)[._-]?(\d*))?"
        r"(?:-(\d+)|[._-]?(post|rev|r)[._-]?(\d*))?(?:[._-]?(dev)[._-]?(\d*))?(?:\+([a-z0-9]+(?:[._-][a-z0-9]+)*))?$"
    )
    part = lambda i: F.regexp_extract(v, pattern, i)
    number = lambda i: _padded(F.when(part(i) == "", "0").otherwise(part(i)))
    release = F.regexp_replace(part(2), r"(\.0+)+$", "")
    numbers = F.array_join(F.transform(F.split(release, r"\."), lambda x: F.concat(F.lit("."), _padded(x))), "")
    stage = part(3)
    for spelled, short in _STAGES.items():
        stage = F.when(part(3) == spelled, short).otherwise(stage)
    has_post, has_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    pre = F.when(part(3) != "", F.concat(F.lit("1"), F.rpad(stage, 2, " "), number(4))).when(~has_post & has_dev, "0").otherwise("2")
    post = F.when(has_post, F.concat(F.lit("1"), F.when(part(5) != "", _padded(part(5))).otherwise(number(7)))).otherwise("0")
    dev = F.when(has_dev, F.concat(F.lit("0"), number(9))).otherwise("1")
    locals_ = F.transform(F.split(part(10), "[._-]"), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("1"), _padded(p))).otherwise(F.concat(F.lit("0"), p)))
    local = F.when(part(10) == "", "").otherwise(F.concat(F.lit("!"), F.array_join(locals_, "!")))
    return F.when(v.rlike(pattern), F.concat(number(1), numbers, F.lit("!"), pre, post, dev, local))


def version_key(ecosystem: Column, version: Column) -> Column:
    """A text that sorts as the ecosystem orders its versions."""
    return F.when(ecosystem == "pypi", pep440_key(version)).otherwise(semver_key(version))


def age_days(created: Column, now: Column) -> Column:
    """Whole days, cut toward zero; null if the text is no time."""
    then = F.try_to_timestamp(created)
    return F.timestamp_diff("DAY", then, now)


def rule_slug(rule_id: Column) -> Column:
    return F.replace(F.substring_index(rule_id, "/", -1), F.lit("-"), F.lit(" "))
