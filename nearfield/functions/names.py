"""Names, labels and parsed fields of benchmark records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Datasets by benchmark case id.
CASE_NAMES = {
    1: "SIFT (500K × 128)",
    2: "GIST (100K × 960)",
    3: "LAION (100M × 768)",
    4: "Cohere (10M × 768)",
    5: "Cohere (1M × 768)",
    6: "Cohere (10M × 768)",
    7: "Cohere (1M × 768)",
    8: "Cohere (10M × 768)",
    9: "Cohere (1M × 768)",
    10: "OpenAI (500K × 1536)",
    11: "OpenAI (5M × 1536)",
    12: "OpenAI (500K × 1536)",
    13: "OpenAI (5M × 1536)",
    14: "OpenAI (500K × 1536)",
    15: "OpenAI (5M × 1536)",
    17: "Bioasq (1M × 1024)",
    20: "Bioasq (10M × 1024)",
    50: "OpenAI (50K × 1536)",
    500: "OpenAI (999K × 1536)",
    501: "Agnews (769K × 1024)",
    502: "ArxivForFanns (1.2M × 1024)",
    503: "SIFT (4999K × 128)",
    504: "Cohere (6M × 768)",
    600: "ArxivForFanns (1.2M × 1024)",
    601: "Cohere (6M × 768)",
}

# Exact row counts where the rounded name differs.
EXACT_COUNTS = {
    "Agnews (769K × 1024)": 769_382,
    "Cohere (6M × 768)": 6_021_120,
}

# Fixed value: the format of a dataset's display name.
_DATASET = r"^(.+?)\s*\((\d+(?:\.\d+)?)\s*([KM]?)\s*×\s*(\d+)"


def parse_dataset(name: Column) -> Column:
    """``"Name (1.2M × 1024)"`` as a struct of base name, count label, count, dims and bytes.

    Names of another form keep the text before the bracket and null numbers.
    """
    fits = name.rlike(_DATASET)

    def part(i: int) -> Column:
        return F.when(fits, F.regexp_extract(name, _DATASET, i))

    unit = part(3)
    factor = F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1)
    count = (part(2).cast("double") * factor).cast("long")
    dims = part(4).cast("long")
    base = F.coalesce(F.trim(part(1)), F.trim(F.substring_index(name, "(", 1)))
    return F.struct(
        base.alias("base"),
        F.concat(part(2), unit).alias("count_label"),
        count.alias("n"),
        dims.alias("d"),
        (count * dims * 4).alias("bytes"),
    )


def dataset_label(name: Column, separator: str = ", ", brackets: bool = True) -> Column:
    """Name with count, dimension and float32 size in GiB."""
    p = parse_dataset(name)
    gib = F.format_string("%.2f GiB", p["bytes"] / F.lit(float(1024**3)))
    facts = F.concat(
        F.lit("n="), p["count_label"], F.lit(", d="), p["d"].cast("string"),
        F.lit(separator), gib,
    )
    shown = F.concat(F.lit("("), facts, F.lit(")")) if brackets else facts
    return F.coalesce(F.concat(p["base"], F.lit("\n"), shown), p["base"])


def order_datasets(df: DataFrame, name: str = "dataset") -> DataFrame:
    """By size in bytes, then dimension, then count; names that do not parse come last."""
    p = parse_dataset(F.col(name))
    return df.orderBy(
        p["bytes"].asc_nulls_last(), p["d"].asc_nulls_last(), p["n"].asc_nulls_last(), name
    )


def case_dataset(df: DataFrame, cases: Mapping[int, str] = CASE_NAMES, case: str = "case_id",
                 fallback: str = "Unknown (case_id=%s)") -> DataFrame:
    """Adds ``dataset`` by case id, with a fallback text for unknown cases."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(cases.items()), f"{case} long, dataset string")
    unknown = F.format_string(fallback, F.col(case).cast("string"))
    return df.join(F.broadcast(table), case, "left").withColumn(
        "dataset", F.coalesce("dataset", unknown)
    )


# Display names by index kind.
FLAT_NAME = "DuckDB"
GRAPH_NAME = "DuckDB VSS (HNSW)"
PG_NAMES = {"hnsw": "pgvector (HNSW)", "ivfflat": "pgvector (IVFFlat)"}


def index_name(
    kind: Column, quantisation: Column, global_version: Column, *, ivf_kind: str, ivf_name: str
) -> Column:
    """Display name of an embedded-engine index.

    ``ivf_kind`` is the kind under which the inverted-list index is recorded and ``ivf_name`` how
    it is shown; its name also tells global from row-group-local lists and the element type.
    """
    scope = F.when(global_version.isNotNull(), "Global").otherwise("Row Group")
    element = F.upper(F.coalesce(quantisation, F.lit("f32")))
    ivf = F.concat(F.lit(f"{ivf_name} (IVF, "), scope, F.lit(", "), element, F.lit(")"))
    return (
        F.when(kind == "FLAT", FLAT_NAME)
        .when(kind == "HNSW", GRAPH_NAME)
        .when(kind == ivf_kind, ivf)
        .otherwise(kind)
    )


def pg_index_name(kind: Column) -> Column:
    """Display name of a PostgreSQL index, whatever the case of its kind."""
    name = kind
    for known, shown in PG_NAMES.items():
        name = F.when(F.lower(kind) == known, shown).otherwise(name)
    return name


def strip_quantisation(name: Column) -> Column:
    return F.regexp_replace(name, r", (F32|U8)\)$", ")")


def variant_name(name: Column, build: Column, variant_build: str, variant: str) -> Column:
    """Mark global indexes that come from one particular build as their own variant."""
    marked = F.regexp_replace(name, r"\(IVF, Global,", f"(IVF, {variant},")
    return F.when(build == variant_build, marked).otherwise(name)


def index_position(name: Column, order: Sequence[str]) -> Column:
    """Sort key that follows a given list; names outside it come last (null)."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), name)
    return F.when(place > 0, place)


def label_field(db_label: Column, field: str) -> Column:
    """A field of the JSON text inside a result record; a missing text counts as ``{}``."""
    return F.get_json_object(F.coalesce(db_label, F.lit("{}")), f"$.{field}")


def dataset_order(new_key: Column, legacy_sorted: Column) -> Column:
    """Row order of a run: the explicit field, else the older flag, else the original order."""
    legacy = F.when(F.coalesce(legacy_sorted, F.lit(False)), "sorted_by_update_date")
    return F.coalesce(new_key, legacy, F.lit("original"))


def dataset_order_shuffled(new_key: Column, legacy_key: Column) -> Column:
    """Row order of a run whose dataset is stored shuffled by default."""
    return F.coalesce(new_key, legacy_key, F.lit("randomly_shuffled"))


def filter_type(unified: Column, legacy: Column) -> Column:
    """The filter type, falling back to the older key when empty or missing."""
    return F.coalesce(F.when(unified != "", unified), legacy)


def short_dataset_labels(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Adds ``short``: the base name, with the row count only where base names collide."""
    p = parse_dataset(F.col(name))
    names = df.select(name).distinct().select(
        name, p["base"].alias("__base"), F.coalesce(p["count_label"], F.lit("")).alias("__count")
    )
    same = F.count("*").over(Window.partitionBy("__base"))
    shown = F.when(same > 1, F.concat("__base", "__count")).otherwise(F.col("__base"))
    return df.join(names.select(name, shown.alias("short")), name)


def short_system_label(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "DuckDB ", ""), r"\(IVF, ", "(")


# Fixed value: the format of a task label.
_TASK = r"^([^_]+)_(?:(.+)_)?(\d{2}-\d{2}-\d{2})$"


def task_tags(task_label: Column) -> Column:
    """Tool, case and time out of ``tool_case_HH-MM-SS`` (the case may be missing)."""
    case = F.regexp_extract(task_label, _TASK, 2)
    return F.struct(
        F.regexp_extract(task_label, _TASK, 1).alias("tool"),
        F.when(case != "", case).alias("case"),
        F.regexp_extract(task_label, _TASK, 3).alias("time"),
    )


# The units of sizes.
_UNITS = ["KiB", "MiB", "GiB", "TiB"]


def format_bytes(n: Column, decimals: int = 2) -> Column:
    """A byte count with a binary unit; plain bytes never show decimals."""
    value = n.cast("double")
    text = F.when(F.abs(value) < 1024, F.format_string("%.0f B", value))
    for power, unit in enumerate(_UNITS, start=1):
        scaled = value / float(1024**power)
        text = text.when(F.abs(scaled) < 1024, F.format_string(f"%.{decimals}f {unit}", scaled))
    return text.otherwise(F.format_string(f"%.{decimals}f PiB", value / float(1024**5)))
