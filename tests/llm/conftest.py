"""Tables of the curation problems with all columns they are read by, and two that clash with inner names."""

import pytest

IMAGES = "row_no long, image_id string, source_id string, source_url string, caption string, file_sha256 string, curation_status string, split string, ahash string, key string, hash string"
SOURCES = "row_no long, source_id string, doi string, domain string, license string, license_url string, license_status string, accessed_at string, letters string"
DOCS = "doc_id long, text string, lang string, source string, fp long, tokens long"


@pytest.fixture
def images(spark):
    def make(*rows):
        names = [f.split()[0] for f in IMAGES.split(", ")]
        return spark.createDataFrame([tuple(r.get(n, "clash" if n in ("key", "hash") else None) for n in names) for r in rows], IMAGES)

    return make


@pytest.fixture
def sources(spark):
    def make(*rows):
        names = [f.split()[0] for f in SOURCES.split(", ")]
        return spark.createDataFrame([tuple(r.get(n, "clash" if n == "letters" else None) for n in names) for r in rows], SOURCES)

    return make


@pytest.fixture
def docs(spark):
    return lambda *rows: spark.createDataFrame([(i, t, lang, src, 7, 7) for i, t, lang, src in rows], DOCS)
