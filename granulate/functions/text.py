"""Identifiers, names, addresses and rule-based classes of curation rows as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulate.functions.normalise import let

# Fixed values of the rules below.
LICENCE_PATTERNS = ("cc by", "cc-by", "cc_by", "creative commons attribution", "creativecommons.org/licenses/by", "cc0", "public domain")
LICENCE_DENIED = ("noncommercial", "no derivatives", "no-derivatives")
PUBLIC_HINTS = ("cc by", "cc-by", "cc0", "public domain")
BLOCKED_HINTS = ("nc", "nd", "noncommercial", "no derivatives")
NULL_TOKENS = ("", "na", "n/a", "nan", "none", "null")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp")
IMAGE_BLOCKED = ("logo", "icon", "avatar", "sprite", "banner", "ads", "placeholder")
IMAGE_WANTED = ("fig", "figure", "image", "tem", "stem", "sem", "graph", "media", ".tif", ".jpg", ".png")
CONTENT_LAYERS = ("real_exact", "real_near", "synthetic_core_shell", "unknown")
SYNTHETIC_HINTS = ("synthetic", "phantom", "simulated")
CORE_SHELL_HINTS = (
    "au@sio2", "au@sio₂", "au-sio2", "au/sio2", "au sio2", "core-shell", "core shell", "coreshell",
    "gold core", "au core", "silica shell", "sio2 shell",
)
NEAR_HINTS = (
    "nanoparticle", "nanoparticles", "nanorod", "nanosphere", "colloid", "tem", "stem", "haadf", "bf-tem", "sem",
    "micrograph", "electron microscopy", "electron micrograph", "emps",
)
CLASS_ALIASES = {
    "au core": "Au_core", "core": "Au_core", "gold core": "Au_core", "au": "Au_core", "gold": "Au_core",
    "sio2 outer": "SiO2_outer", "sio2": "SiO2_outer", "silica": "SiO2_outer", "silica outer": "SiO2_outer",
    "sio2 carrier": "SiO2_outer", "carrier": "SiO2_outer", "shell": "SiO2_outer", "outer": "SiO2_outer",
}
REVIEW_STATUSES = ("needs_review", "uncertain", "ambiguous", "ignore", "ignored", "difficult")
CLASS_FOLDERS = {
    "tem": "tem_candidates", "graph": "graphs", "abstract_or_scheme": "abstracts_or_schemes",
    "mixed_figure": "mixed", "needs_review": "needs_review",
}
GROUP_FIELDS = (
    "micrograph_id", "original_micrograph_id", "parent_micrograph_id", "figure_id", "source_figure_id",
    "source_id", "source_group", "doi", "acquisition_session",
)


def filled(c: Column) -> Column:
    """Trimmed text, NULL if blank."""
    return let(F.trim(c), lambda t: F.when(t != "", t))


def any_of(text: Column, hints) -> Column:
    """Whether the text holds one of the hints."""
    found = F.lit(False)
    for h in hints:
        found = found | F.contains(text, F.lit(h))
    return found


def joined(*cols: Column) -> Column:
    """Columns in lower case joined by blanks; NULL counts as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def number(c: Column) -> Column:
    """Number of a cell; null tokens, infinities and NaN are NULL, anything else unreadable is NULL too (see `unreadable`)."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TOKENS) & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def unreadable(c: Column) -> Column:
    """Whether a cell is neither a number nor a null token."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*NULL_TOKENS) & F.trim(c).try_cast("double").isNull()


def stable_id(prefix: str, value: Column) -> Column:
    """prefix_ and the first 12 hex digits of the SHA-1."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(value), 1, 12))


def stable_hash(value: Column) -> Column:
    return F.sha1(value)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def settings_fingerprint(*settings: Column) -> Column:
    """SHA-256 of the compact JSON of the settings, in the order given (sort them by name); local to this engine."""
    return F.sha2(F.to_json(F.struct(*settings)), 256)


def source_address(c: Column) -> Column:
    """Address of a typed source: doi: and bare DOIs go to doi.org, others get a scheme."""

    def build(t: Column) -> Column:
        return (
            F.when(t == "", "")
            .when(F.lower(t).startswith("doi:"), F.concat(F.lit("https://doi.org/"), F.trim(F.substring(t, 5, 1 << 20))))
            .when(t.rlike(r"(?i)^10\.\d{4,9}/"), F.concat(F.lit("https://doi.org/"), t))
            .when(~t.rlike(r"(?i)^https?://"), F.concat(F.lit("https://"), t))
            .otherwise(t)
        )

    return let(F.trim(c), build)


def domain(url: Column) -> Column:
    """Host with port in lower case; every `www.` is dropped."""
    return F.replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def url_path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def in_domains(host: Column, domains) -> Column:
    """Whether a host is one of the domains or below one."""
    ok = F.lit(False)
    for d in domains:
        ok = ok | (host == d) | host.endswith("." + d)
    return ok


def source_adapter(url: Column) -> Column:
    """Which reader a source address needs."""
    d = domain(url)
    is_image = F.lit(False)
    for s in IMAGE_SUFFIXES:
        is_image = is_image | url_path(url).endswith(s)
    return (
        F.when(d == "doi.org", "doi")
        .when(d.contains("zenodo.org"), "zenodo")
        .when(d.contains("figshare.com"), "figshare")
        .when(d.contains("ncbi.nlm.nih.gov"), "pmc")
        .when(d.contains("mdpi.com"), "mdpi")
        .when(is_image, "direct_image")
        .otherwise("generic_html")
    )


def zenodo_id(url: Column) -> Column:
    return F.regexp_extract(url, r"zenodo\.org/(?:records|record)/(\d+)", 1)


def figshare_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/(\d+)(?:/\d+)?/?$", 1)


def keep_image(url: Column, text: Column) -> Column:
    """Whether a scraped picture may be a figure."""
    all_ = joined(url, text)
    typed = F.lit(False)
    for s in IMAGE_SUFFIXES:
        typed = typed | url_path(url).endswith(s) | all_.contains(s + "?")
    return typed & ~any_of(all_, IMAGE_BLOCKED) & any_of(all_, IMAGE_WANTED)


def licence_allowed(text: Column) -> Column:
    """Whether a text names a licence that allows public use."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return ~any_of(t, LICENCE_DENIED) & ~t.rlike(r"cc[-_\s]?by[-_\s]?(nc|nd)") & any_of(t, LICENCE_PATTERNS)


def licence_status(text: Column, rejected: str = "rejected") -> Column:
    """missing, accepted or the status named `rejected`."""
    return F.when(F.coalesce(text, F.lit("")) == "", "missing").when(licence_allowed(text), "accepted").otherwise(rejected)


def public_licence(status: Column, *texts: Column, with_status: bool = False) -> Column:
    """Whether licence texts are public; blocked hints are plain substrings, as the rule has it.

    with_status: the status is part of the text (the exporter's variant).
    """
    t = joined(*texts, *([status] if with_status else []))
    ok = (F.lower(F.trim(F.coalesce(status, F.lit("")))) == "accepted") | any_of(t, PUBLIC_HINTS)
    return ok & ~any_of(t, BLOCKED_HINTS)


def modality(text: Column) -> Column:
    """Imaging mode named in a text, by ordered substrings."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("haadf"), "HAADF")
        .when(any_of(t, ("bf-tem", "bright-field tem")), "BF-TEM")
        .when(t.contains("stem"), "STEM")
        .when(any_of(t, ("tem", "transmission electron")), "TEM")
        .when(any_of(t, ("sem", "scanning electron")), "SEM")
        .otherwise("unknown")
    )


def content_layer(declared: Column, text: Column) -> Column:
    """What an image shows: the declared layer or family, else by hints in the text."""
    d = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(d.isin(*CONTENT_LAYERS), d)
        .when(d.startswith("real_near"), "real_near")
        .when(d.startswith("real_exact"), "real_exact")
        .when(any_of(d, SYNTHETIC_HINTS), "synthetic_core_shell")
        .when(any_of(t, SYNTHETIC_HINTS), "synthetic_core_shell")
        .when(any_of(t, CORE_SHELL_HINTS), "real_exact")
        .when(any_of(t, NEAR_HINTS), "real_near")
        .otherwise("unknown")
    )


def class_name(c: Column) -> Column:
    """Canonical class of a label, the label itself if unknown."""
    key = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[-_\s]+", " ")))
    names = F.create_map(*[F.lit(x) for kv in CLASS_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), c)


def needs_review(*status: Column, crowd: Column | None = None) -> Column:
    """Whether one of the status fields of an annotation, or its crowd flag, asks for review."""
    flag = F.coalesce(crowd.cast("boolean"), F.lit(False)) if crowd is not None else F.lit(False)
    for s in status:
        flag = flag | F.coalesce(F.lower(F.trim(s)).isin(*REVIEW_STATUSES), F.lit(False))
    return flag


def attribute(attributes: Column, name: str) -> Column:
    """Value of a [{name, value}] attribute list, the last of the name."""
    return F.get(F.filter(attributes, lambda a: F.lower(a["name"]) == name), F.size(F.filter(attributes, lambda a: F.lower(a["name"]) == name)) - 1)["value"]


def safe_name(c: Column, fallback: Column, most: int = 120) -> Column:
    """ASCII file name of at most `most` characters."""
    return let(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, most), lambda t: F.when(t != "", t).otherwise(fallback))


def safe_stem(c: Column) -> Column:
    """File stem that keeps letters and digits of any script."""
    return let(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), r"^[._]+|[._]+$", ""), lambda t: F.when(t != "", t).otherwise("image"))


def safe_slug(c: Column, most: int = 72) -> Column:
    """Slug; longer ones are cut and get 8 digits of their SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return let(slug, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("_"), F.substring(F.sha1(c), 1, 8))).otherwise(t))


def split_inputs(c: Column) -> Column:
    """Entries of a list typed with line breaks, commas or semicolons."""
    return F.filter(F.transform(F.split(c, r"[\n,;]+"), F.trim), lambda x: x != "")


def key_values(c: Column) -> Column:
    """JSON object, else `k=v;k=v`, as map of strings."""
    pairs = F.filter(F.split(c, ";"), lambda p: p.contains("="))
    kv = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))))
    return F.coalesce(F.when(F.ltrim(c).startswith("{"), F.from_json(c, "map<string,string>")), kv)


def manual_label(name: Column, predicted: Column) -> Column:
    """struct(label, marker) a reviewer put into a file name."""
    n = F.lower(name)
    mark = (
        F.when(any_of(n, ("graf", "graph")), "manual_renamed_graph")
        .when(n.contains("abstract"), "manual_renamed_abstract")
        .when(any_of(n, ("separar", "separate", "split")), "manual_needs_split")
        .otherwise("unrenamed_counted_correct")
    )
    label = F.when(any_of(n, ("graf", "graph")), "graph").when(n.contains("abstract"), "abstract_or_scheme").otherwise(predicted)
    return F.struct(label.alias("label"), mark.alias("marker"))


def page_number(name: Column) -> Column:
    """Number of a name that starts with three digits and an underscore."""
    return F.regexp_extract(name, r"^(\d{3})_", 1).try_cast("int")


def class_folder(c: Column) -> Column:
    folders = F.create_map(*[F.lit(x) for kv in CLASS_FOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(folders, c), F.lit("needs_review"))


def leakage_group(columns: list[str], *fallback: str) -> Column:
    """First filled field of the priority list that the table has, else of `fallback`."""
    names = [n for n in GROUP_FIELDS if n in columns] + [n for n in fallback if n in columns]
    return F.coalesce(*[filled(F.col(n).cast("string")) for n in names])


def average_hash(values: Column) -> Column:
    """'1' where a grid cell is at least the mean, else '0'."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.nullif(F.size(values), F.lit(0))
    return let(mean, lambda m: F.array_join(F.transform(values, lambda v: F.when(v >= m, "1").otherwise("0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two texts; NULL if one is empty or they differ in length."""
    ones = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), ones)


def file_name(url: Column) -> Column:
    """Last part of an address's path."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)


def relative_to(path: Column, root: str) -> Column:
    """Path below `root`, else the path itself."""
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.coalesce(path, F.lit("")))


def figure(c: Column, digits: int = 4) -> Column:
    """Number as text with fixed decimals; 0 and NULL are blank."""
    return F.when(c.isNotNull() & (c != 0), F.format_string(f"%.{digits}f", c)).otherwise("")
