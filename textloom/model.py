"""Schemas, enumerations and limits of the search engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Extensions that can be searched.
OFFICE_EXTENSIONS = ("xlsx", "xlsm", "pptx", "docx")
TEXT_EXTENSIONS = tuple(
    """txt md markdown mdx rst adoc log csv tsv
    jsp xhtml html htm vue svelte astro css scss sass less svg
    js mjs cjs jsx ts mts cts tsx
    java kt kts groovy gradle py rb php go rs c h cc cpp hpp cs swift scala sh bash zsh ps1 bat cmd sql dart lua r jl pl ex exs clj cljs fs fsx vb vbs
    json jsonc jsonl ndjson yaml yml toml xml xsd xsl xslt ini cfg conf properties tf hcl tfvars
    graphql gql proto ipynb""".split()
)
EXTENSIONS = OFFICE_EXTENSIONS + TEXT_EXTENSIONS
DEFAULT_EXTENSIONS = ("xlsx", "xlsm", "pptx", "docx", "txt")

# Kinds of match and their scores.
SCORES = {"exact": 100, "caseFolded": 98, "normalized": 95, "separatorVariant": 92, "identifier": 90, "kanaVariant": 88, "prefix": 80, "substring": 70, "editDistance": 50}

# Limits.
MAX_TEXT_BYTES = 32 << 20
MAX_PART_BYTES, MAX_PACKAGE_BYTES, MAX_PARTS = 32 << 20, 128 << 20, 4096
MAX_TABLE_DEPTH, MAX_REPLY_DEPTH = 16, 16
MAX_CONDITION_TERMS, MAX_RAW_CONDITIONS, MAX_BATCH_TERMS, MAX_RAW_BATCH, MAX_TERM_CHARS = 32, 128, 256, 4096, 200
MAX_ROW, MAX_COLUMN = 1_048_576, 16_384
PREVIEW_CHARS, CLIP_CHARS, MERGE_CAP, WINDOW_SIDE = 240, 300, 25, 2
EXTRACTION_VERSION, INDEX_VERSION = 4, 3

UNIT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("unit_seq", T.IntegerType()),  # 0: the file's name
        T.StructField("source_kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("unit_key", T.StringType()),
        T.StructField("part_key", T.StringType()),
        T.StructField("group_key", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("content_class", T.StringType()),
        T.StructField("anchor", T.StringType()),
        T.StructField("location", T.StringType()),  # canonical JSON
        T.StructField("document_order", T.ArrayType(T.LongType())),
    ]
)
ISSUE = T.StructType([T.StructField(x, T.StringType()) for x in ("stage", "path", "code", "reason")])
SHEET = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("part_key", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("merges", T.ArrayType(T.StringType())),
        T.StructField("hidden_rows", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("hidden_columns", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("layout", T.StringType()),  # JSON: styles, widths, heights, cell and row and column styles
    ]
)
MATCH = T.StructType([T.StructField("kind", T.StringType()), T.StructField("category", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
