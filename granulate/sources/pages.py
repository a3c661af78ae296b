"""Metadata of HTML pages and of repository records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulate.functions import text as t

FIELDS = ["title", "doi", "authors", "journal", "year", "publisher", "abstract", "keywords"]
# Meta names by field.
META = {
    "title": ("citation_title", "dc.title", "og:title"), "doi": ("citation_doi", "dc.identifier", "dc.identifier.doi"), "authors": ("citation_author", "dc.creator"),
    "journal": ("citation_journal_title", "dc.source", "prism.publicationname"), "year": ("citation_publication_date", "citation_date", "dc.date", "article:published_time"),
    "publisher": ("citation_publisher", "dc.publisher"), "abstract": ("citation_abstract", "description", "dc.description"),
    "keywords": ("citation_keywords", "keywords", "dc.subject"),
}
LICENCE = re.compile(r"creativecommons\.org/licenses/[a-z0-9./-]+|CC[-\s]?BY(?:[-\s]NC)?(?:[-\s]ND)?|CC0", re.I)
HEAD = 5000  # characters of a page in which a licence is looked for if no tag names one, as the rule has it


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.title, self.licence, self.images, self.captions, self.open = [], "", "", [], [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()) and a.get("content"):
            self.meta.append((name, a["content"].strip()))
        elif tag in ("link", "a") and "license" in a.get("rel", "").lower() and a.get("href"):
            self.licence = a["href"]
        elif tag == "img" and a.get("src"):
            self.images.append((a["src"], a.get("alt", "")))
        elif tag in ("title", "figcaption"):
            self.open = tag
            if tag == "figcaption":
                self.captions.append("")

    def handle_endtag(self, tag):
        if tag == self.open:
            self.open = None

    def handle_data(self, data):
        if self.open == "title":
            self.title += data
        elif self.open == "figcaption":
            self.captions[-1] += data


def metadata(pages: DataFrame) -> DataFrame:
    """page_id, the fields, images (address, alt) and captions of pages(page_id, url, html); a page that cannot be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                p, row = _Page(), {"page_id": key, "error": None}
                try:
                    p.feed(html or "")
                except Exception as e:  # a broken page is a row with a reason, not a failed job
                    row["error"] = str(e)
                for f in FIELDS:
                    got = [c for n, c in p.meta if n in META[f]]
                    if f == "year":
                        got = [y.group() for c in got if (y := re.search(r"\d{4}", c))]
                    # The last tag of a field counts, the first one of the abstract; authors are all of them.
                    row[f] = "; ".join(got) if f == "authors" else got[0 if f == "abstract" else -1] if got else ""
                row["title"] = row["title"] or p.title.strip()
                row |= _licence(p, html or "", row["title"])
                row["images"] = [{"address": urljoin(url or "", s), "alt": a} for s, a in p.images]
                row["captions"] = [c.strip() for c in p.captions if c.strip()]
                out.append(row)
            yield pd.DataFrame(out, columns=["page_id", *FIELDS, "license", "license_url", "images", "captions", "error"])

    schema = "page_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", license string, license_url string, images array<struct<address:string,alt:string>>, captions array<string>, error string"
    rows = pages.select("page_id", "url", "html").mapInPandas(run, schema)
    return rows.withColumn("modality", t.modality(F.concat_ws(" ", "title", "abstract"))).withColumn("license_status", t.licence_status(F.trim(F.concat_ws(" ", "license", "license_url"))))


def _licence(page: _Page, html: str, title: str) -> dict[str, str]:
    """Licence text and address: of a link, else of a tag that speaks of licence or rights, else of the page's text."""
    said = [c for n, c in page.meta if "license" in n or "rights" in n]
    if page.licence:
        return {"license": page.licence, "license_url": page.licence}
    if said:
        return {"license": said[-1], "license_url": next((c for c in reversed(said) if c.startswith("http")), "")}
    m = LICENCE.search(" ".join([*(c for _, c in page.meta), title, html[:HEAD]]))
    found = m.group() if m else ""
    return {"license": found, "license_url": f"https://{found}" if found.lower().startswith("creativecommons") else ""}


def figures(meta: DataFrame, most: int) -> DataFrame:
    """page_id, pos, address, alt of pictures that may be figures, at most `most` kept a page (the cap is the feature)."""
    i = meta.select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "i.*").where(t.keep_image(F.col("address"), F.col("alt")))
    from granulate.operators.curation import capped

    return capped(i, ["page_id"], [F.col("pos")], most).drop("rn")


RECORD = "struct<title:string,doi:string,publication_date:string,description:string,keywords:array<string>,creators:array<struct<name:string>>,license:struct<id:string>>"


def record(json: Column) -> Column:
    """Source fields of a repository record (its JSON metadata); NULL if it is not readable."""
    m = F.from_json(json, f"struct<metadata:{RECORD}>")["metadata"]
    return F.when(m.isNotNull(), F.struct(
        m["title"].alias("title"), m["doi"].alias("doi"), F.substring(m["publication_date"], 1, 4).alias("year"), m["license"]["id"].alias("license"),
        F.array_join(F.transform(m["creators"], lambda c: c["name"]), "; ").alias("authors"), F.array_join(m["keywords"], "; ").alias("keywords"),
        t.licence_status(m["license"]["id"]).alias("license_status"),
    ))


def overlay(old: Column, new: Column) -> Column:
    """The new value unless it is blank."""
    return F.coalesce(t.filled(new), old)


ARTICLE = (
    "struct<title:string,doi:string,published_date:string,description:string,tags:array<string>,authors:array<struct<full_name:string>>,"
    "license:struct<name:string,url:string>,files:array<struct<name:string,download_url:string>>>"
)
RECORD_FILES = "struct<files:array<struct<key:string,links:struct<self:string,download:string>>>>"


def article(json: Column) -> Column:
    """Source fields of an article record (its JSON); NULL if it is not readable."""
    a = F.from_json(json, ARTICLE)
    licence = F.concat_ws(" ", t.filled(a["license"]["name"]), t.filled(a["license"]["url"]))
    names = F.filter(F.transform(a["authors"], lambda x: t.filled(x["full_name"])), lambda n: n.isNotNull())
    return F.when(a.isNotNull() & (a["title"].isNotNull() | a["doi"].isNotNull()), F.struct(
        a["title"].alias("title"), a["doi"].alias("doi"), F.substring(a["published_date"], 1, 4).alias("year"), licence.alias("license"), a["license"]["url"].alias("license_url"),
        F.array_join(names, "; ").alias("authors"), F.array_join(a["tags"], "; ").alias("keywords"), t.licence_status(licence).alias("license_status"),
        t.modality(F.concat_ws(" ", a["title"], a["description"])).alias("modality"),
    ))


def record_files(json: Column, most: int) -> Column:
    """array<struct<name, address>>: pictures among the first `most` files of a record of either kind; the cut comes before the choice."""
    zen = F.transform(F.slice(F.from_json(json, RECORD_FILES)["files"], 1, most), lambda f: F.struct(f["key"].alias("name"), F.coalesce(f["links"]["self"], f["links"]["download"]).alias("address")))
    fig = F.transform(F.slice(F.from_json(json, ARTICLE)["files"], 1, most), lambda f: F.struct(f["name"].alias("name"), f["download_url"].alias("address")))
    both = F.concat(F.coalesce(zen, F.array().cast("array<struct<name:string,address:string>>")), F.coalesce(fig, F.array().cast("array<struct<name:string,address:string>>")))
    typed = lambda n: F.lower(n).rlike(r"\.(?:" + "|".join(s[1:] for s in t.IMAGE_SUFFIXES) + ")$")
    return F.filter(both, lambda f: (F.coalesce(f["address"], F.lit("")) != "") & typed(F.coalesce(f["name"], F.lit(""))))


def validated(fetched: DataFrame) -> DataFrame:
    """raw, adapter, status, reason, license_status and title of every typed source; a source that fails has its reason and is never lost.

    fetched: raw (as typed), content (what its address gave, NULL if nothing), error (why, else NULL). Records are
    read by their kind; pages only by their title and licence link, direct pictures have no licence.
    """
    url = t.source_address(F.col("raw"))
    kind = t.source_adapter(url)
    rec, art = record(F.col("content")), article(F.col("content"))
    page = F.struct(
        F.nullif(F.trim(F.regexp_extract("content", r"(?is)<title[^>]*>([^<]*)<", 1)), F.lit("")).alias("title"),
        F.regexp_extract("content", r"(?i)href=[\"']([^\"']*creativecommons\.org/[^\"']*)", 1).alias("licence"),
    )
    fields = (
        F.when(kind == "zenodo", F.struct(rec["title"].alias("title"), rec["license_status"].alias("license_status")))
        .when(kind == "figshare", F.struct(art["title"].alias("title"), art["license_status"].alias("license_status")))
        .when(kind != "direct_image", F.struct(page["title"].alias("title"), t.licence_status(page["licence"]).alias("license_status")))
    )
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("content").isNull(), "nothing was fetched")
        .when((kind == "figshare") & (t.figshare_id(url) == ""), "no article id in the address").when((kind == "zenodo") & (t.zenodo_id(url) == ""), "no record id in the address")
        .when(kind.isin("zenodo", "figshare") & F.col("f.license_status").isNull(), "the record cannot be read").when(kind == "direct_image", "a picture has no licence of its own")
        .when(F.col("f.license_status") == "accepted", "public licence found").when(F.col("f.license_status") == "missing", "no public licence found").otherwise("the licence is not public")
    )
    return fetched.withColumn("f", fields).select(
        "raw", kind.alias("adapter"), F.when(F.col("error").isNotNull(), "error").otherwise("done").alias("status"), reason.alias("reason"), F.col("f.license_status").alias("license_status"), F.col("f.title").alias("title"),
    )


SEED = (
    "local_pdf_sources array<struct<title:string,file:string,doi:string,candidate_layer:string,license:string,license_status:string,training_use:string,notes:string>>, "
    "related_datasets array<struct<name:string,url:string,doi:string,images:string,license:string,license_status:string,redistribution_caution:boolean,use:string,notes:string>>"
)


def seed_rows(json: DataFrame) -> DataFrame:
    """dataset, url, doi, license, license_status, exact, use, decision of both lists of seed documents (column `value`, one JSON document a row)."""
    from granulate.functions.layers import discovery_decision

    doc = json.select(F.from_json("value", f"struct<{SEED}>").alias("d")).select("d.*")
    p, r = doc.select(F.explode("local_pdf_sources").alias("p")), doc.select(F.explode("related_datasets").alias("r"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = F.coalesce("p.license_status", F.lit("needs_review"))
    careful = F.coalesce("r.redistribution_caution", F.lit(False))
    return p.select(
        F.coalesce("p.title", "p.file").alias("dataset"), text("p.file").alias("url"), text("p.doi").alias("doi"), text("p.license").alias("license"), state.alias("license_status"),
        F.coalesce(F.col("p.candidate_layer") == "real_exact", F.lit(False)).alias("exact"), text("p.training_use").alias("use"), discovery_decision(state, "hold_for_license_review").alias("decision"),
    ).unionByName(r.select(
        text("r.name").alias("dataset"), text("r.url").alias("url"), text("r.doi").alias("doi"), text("r.license").alias("license"),
        F.when(careful, "needs_review").otherwise(F.coalesce("r.license_status", F.lit("needs_review"))).alias("license_status"), F.lit(False).alias("exact"), text("r.use").alias("use"),
        F.when(careful, "hold_for_license_review").otherwise("inspect").alias("decision"),
    ))
