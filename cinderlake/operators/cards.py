"""Agent cards: identity, confusable names, provider and signature presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpora, names
from ..functions import text as T
from ..schemas import CARD
from . import text_rules
from .text_rules import finding


def parse_cards(cards: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``card``, a struct; null for text that is no JSON object."""
    known = F.startswith(F.schema_of_variant(F.try_parse_json(F.col(text))), F.lit("OBJECT"))
    return cards.select(*keys, F.when(known, F.from_json(F.col(text), CARD)).alias("card"))


def fetched_cards(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """``targets``: ``target``; ``responses``: ``url, status, body``.  The first candidate URL that answered 200."""
    wanted = targets.select("target", F.posexplode(names.card_urls(F.col("target"))).alias("ord", "url"))
    met = wanted.join(responses.where("status = 200"), "url")
    place = F.row_number().over(Window.partitionBy("target").orderBy("ord"))
    return met.withColumn("_p", place).where("_p = 1").select("target", "url", "body", names.url_host(F.col("url")).alias("served_host"))


def text_fields(cards: DataFrame, keys: list[str]) -> DataFrame:
    """``path, text`` of every field that a reader sees."""
    c = F.col("card")
    named = lambda path, x: F.struct(path.alias("path") if isinstance(path, Column) else F.lit(path).alias("path"), x.alias("text"))
    top = F.array(named("name", c["name"]), named("description", c["description"]), named("provider.organization", c["provider"]["organization"]))

    def of_skill(s: Column, i: Column) -> Column:
        at = lambda f: F.concat(F.lit("skills["), i.cast("string"), F.lit("]."), F.lit(f))
        tags = F.transform(F.coalesce(s["tags"], F.array().cast("array<string>")), lambda t, j: named(F.concat(at("tags["), j.cast("string"), F.lit("]")), t))
        return F.concat(F.array(named(at("name"), s["name"]), named(at("description"), s["description"])), tags)

    skills = F.flatten(F.transform(F.coalesce(c["skills"], F.array().cast("array<struct<name:string,description:string,tags:array<string>>>")), of_skill))
    return cards.select(*keys, F.inline(F.concat(top, skills))).where("text is not null")


def identity_rules(served_host: Column, declared_url: Column) -> list[Column]:
    declared = names.url_host(declared_url)
    known = served_host.isNotNull() & declared.isNotNull()
    other_site = names.site(served_host) != names.site(declared)
    return [
        F.when(known & other_site, finding("HIGH", "identity", F.concat(F.lit("served from "), served_host, F.lit(" for "), declared), None, 0)),
        F.when(known & ~other_site & (served_host != declared), finding("INFO", "identity", F.concat(F.lit("served from the subdomain "), served_host), None, 1)),
    ]


def name_rules(name: Column, organization: Column) -> list[Column]:
    return [
        F.when(names.name_confusable(name), finding("HIGH", "confusable-name", F.concat(F.lit("looks like "), names.name_skeleton(name)), name, 2)),
        F.when(names.name_confusable(organization), finding("MEDIUM", "confusable-provider", F.concat(F.lit("looks like "), names.name_skeleton(organization)), organization, 3)),
        F.when(organization.isNull(), finding("LOW", "provider", "no provider declared", None, 4)),
        F.when(T.any_of(F.lower(organization), corpora.PROVIDERS), finding("INFO", "provider", "known provider", organization, 5)),
    ]


def signature_state(signatures: Column) -> Column:
    """ABSENT, WELL_FORMED or MALFORMED, from the first signature.  Nothing is verified, and no state says so."""
    first = F.try_parse_json(F.get(signatures, F.lit(0)))
    part = lambda k: F.coalesce(F.try_variant_get(first, f"$.{k}", "string"), F.lit("")) != ""
    return F.when(F.coalesce(F.size(signatures), F.lit(0)) <= 0, "ABSENT").when(F.coalesce(part("protected") & part("signature"), F.lit(False)), "WELL_FORMED").otherwise("MALFORMED")


def signature_rules(state: Column, url: Column) -> list[Column]:
    return [
        F.when((state == "ABSENT") & url.isNotNull(), finding("LOW", "unsigned", "not bound to its domain", None, 6)),
        F.when(state == "WELL_FORMED", finding("INFO", "signature", "present, not verified", None, 7)),
        F.when(state == "MALFORMED", finding("MEDIUM", "signature", "malformed", None, 8)),
    ]


def check_cards(cards: DataFrame, key: str) -> DataFrame:
    """``cards``: key, ``card`` and ``served_host`` (null for a local card).  All findings, ranked."""
    c = F.col("card")
    rows = cards.where("card is not null").withColumn("_state", signature_state(c["signatures"]))
    rules = identity_rules(F.col("served_host"), c["url"]) + name_rules(c["name"], c["provider"]["organization"]) + signature_rules(F.col("_state"), c["url"])
    own = text_rules.scan_rules(rows, [key], rules)
    fields = text_fields(rows, [key]).withColumn("label", F.col("path"))
    return own.unionByName(text_rules.scan_text(fields, [key]))


def in_order(findings: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, from 1: a card's findings by severity, then category; of one category, as they were found."""
    order = Window.partitionBy(key).orderBy("severity_rank", "category", "check_ord", "tool", "phrase_ord", "message")
    return findings.withColumn("place", F.row_number().over(order))
