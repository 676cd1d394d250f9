"""Cards in collected pages: from embedded search state and from links in the markup."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.text import note_id_of, strip
from threadmill.operators.notes import card_fields

# Places of a search page's items in its state, in order of preference.
_CONTAINERS = ["search.noteItems", "search.items", "search.feeds", "search.notes", "items"]


def state_cards(state: Column) -> Column:
    """The raw cards of a search page's state: the first container that is an array, else
    every note of its detail map. An array that is empty wins over later containers."""
    lists = [F.from_json(F.when(F.get_json_object(state, f"$.{p}").startswith("["), F.get_json_object(state, f"$.{p}")), "array<string>") for p in _CONTAINERS]
    entries = F.map_values(F.from_json(F.get_json_object(state, "$.note.noteDetailMap"), "map<string,string>"))
    notes = F.filter(F.transform(entries, lambda e: F.get_json_object(e, "$.note")), lambda n: n.isNotNull())
    return F.coalesce(*lists, notes, F.array().cast("array<string>"))


def search_cards(pages: DataFrame, key: str, state: str) -> DataFrame:
    """(key, pos, card columns) of every card that has an id."""
    rows = pages.select(key, F.posexplode(state_cards(F.col(state))).alias("pos", "raw"))
    inner, whole = F.get_json_object("raw", "$.note"), F.get_json_object("raw", "$.noteCard")
    # A card that keeps its fields under note is brought to the form with noteCard.
    own = F.to_json(F.struct(F.coalesce(F.get_json_object("raw", "$.id"), F.get_json_object("raw", "$.noteId")).alias("id"), F.get_json_object("raw", "$.xsecToken").alias("xsecToken")))
    moved = F.concat(F.regexp_replace(own, r"\}$", ""), F.when(own == "{}", "").otherwise(","), F.lit('"noteCard":'), inner, F.lit("}"))
    flat = rows.withColumn("raw", F.when(inner.isNotNull() & whole.isNull(), moved).otherwise(F.col("raw")))
    return flat.select(key, "pos", *card_fields(F.col("raw"))).where("note_id <> ''")


class _Links(HTMLParser):
    """Links with the texts a title may come from, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.open: dict | None = None
        self.depth: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "a":
            self.open = {"href": a.get("href") or "", "title": a.get("title") or "", "parts": [], "alt": "", "text": ""}
            self.links.append(self.open)
            self.depth = []
        elif self.open is not None:
            if tag == "img":
                self.open["alt"] = self.open["alt"] or a.get("alt") or a.get("aria-label") or ""
            else:
                self.depth.append(tag == "span" or (tag in ("div", "p") and "title" in (a.get("class") or "")))
                if self.depth[-1]:
                    self.open["parts"].append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = None
        elif self.open is not None and self.depth:
            self.depth.pop()

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open["text"] += data
            if any(self.depth):
                self.open["parts"][-1] += data


def links_of(html: str | None) -> list[dict[str, str]]:
    """Each different note link of a page with its title: the title attribute, else the first
    fitting part, else an image's text, else the link's own text."""
    parser = _Links()
    parser.feed(html or "")
    out: dict[str, dict[str, str]] = {}
    for x in parser.links:
        if x["href"] in out or not any(p in x["href"] for p in ("/explore/", "/search_result/", "/discovery/item/")):
            continue
        part = next((t for t in map(str.strip, x["parts"]) if 3 < len(t) < 200), "")
        out[x["href"]] = {"href": x["href"], "title": (x["title"] or part or x["alt"] or x["text"]).strip()[:100]}
    return list(out.values())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("title", T.StringType())])))
def links(html: pd.Series) -> pd.Series:
    return pd.Series([links_of(x) for x in html])


def link_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, note_id, title, href, xsec_token, pos): one card per note of a page, the first
    that carries a token, else the first."""
    rows = pages.select(key, F.posexplode(links(F.col(html))).alias("pos", "a")).select(key, "pos", "a.href", "a.title")
    cards = rows.select("*", note_id_of(F.col("href")).alias("note_id"), F.regexp_extract("href", r"xsec_token=([^&]+)", 1).alias("xsec_token")).where("note_id <> ''")
    best = cards.groupBy(key, "note_id").agg(F.min(F.struct((F.col("xsec_token") == "").alias("bare"), "pos", "title", "href", "xsec_token")).alias("c"))
    return best.select(key, "note_id", "c.title", "c.href", "c.xsec_token", "c.pos")


def first_cards(cards: DataFrame, counts: DataFrame, key: str, limit: int = 15) -> DataFrame:
    """The first cards of each page in order, numbered from 1, with known interaction counts
    (note_id, liked_count, collected_count, comment_count); 0 where a note isn't known."""
    ranked = cards.selectExpr("*", f"row_number() over (partition by {key} order by pos) as index").where(F.col("index") <= limit)
    known = counts.groupBy("note_id").agg(*[F.max(c).alias(c) for c in ("liked_count", "collected_count", "comment_count")])
    return ranked.join(known, "note_id", "left").fillna(0, ["liked_count", "collected_count", "comment_count"])


def written_date(text: Column) -> Column:
    """The first date written as digits in a text, '' if none."""
    return F.coalesce(F.regexp_extract(strip(text), r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", 0), F.lit(""))


