"""Paths, run ids, lists and labels as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import CLASS_NAMES, PERSON


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parse_run(run_id: Column) -> Column:
    """struct(experiment, model, seed, dataset) of ids like X04-y8n-s2-chv; null where the form is another."""
    form = r"^([^-]+)-(.+)-s(\d+)-([^-]+)$"
    part = lambda i: F.regexp_extract(run_id, form, i)
    return F.when(run_id.rlike(form), F.struct(part(1).alias("experiment"), part(2).alias("model"), part(3).cast("int").alias("seed"), part(4).alias("dataset")))


def build_run(experiment: Column, model: Column, seed: Column, dataset: Column) -> Column:
    return F.concat_ws("-", experiment, model, F.concat(F.lit("s"), seed.cast("string")), dataset)


#: Fixed value: the suffix of a dataset's smaller build, which is the same dataset.
RESOLUTION = "-640"


def dataset_of(path: Column, suffix: str = RESOLUTION) -> Column:
    """The dataset of a configuration's path: its stem without the resolution suffix."""
    return F.regexp_replace(stem(path), f"{suffix}$", "")


def other_dataset(dataset: Column, pair: tuple[str, str]) -> Column:
    """The dataset a run is not trained on; null for names outside the pair."""
    return F.when(dataset == pair[0], pair[1]).when(dataset == pair[1], pair[0])


def class_name(cls: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in CLASS_NAMES.items() for x in kv))
    return names[cls]


def join_classes(classes: Column, between: str = "+") -> Column:
    return F.array_join(F.transform(classes, class_name), between)


def required_list(text: Column) -> Column:
    """Class numbers of a comma list, trimmed and lower-cased, in order, once each. Unknown names or person raise."""
    numbers = F.create_map(*(F.lit(x) for k, v in CLASS_NAMES.items() if k != PERSON for x in (v, k)))
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    bad = F.filter(names, lambda x: numbers[x].isNull())
    checked = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("not a required item: "), F.array_join(bad, ", ")))).otherwise(F.lit(None))
    return F.coalesce(checked.cast("array<int>"), F.array_distinct(F.transform(names, lambda x: numbers[x])))


def source_kind(address: Column) -> Column:
    """camera for digits, stream for a network address, images for a path that ends in a slash, else file."""
    a = F.trim(address)
    return F.when(a.rlike(r"^\d+$"), "camera").when(F.lower(a).rlike(r"^(rtsp|rtmp|https?)://"), "stream").when(a.rlike(r"[/\\]$"), "images").otherwise("file")


EXTRA = "- (extra / out of scope)"


def suggest_class(name: Column) -> Column:
    """The core class that a source's class name speaks of, no-helmet or no-vest where it speaks of its absence; EXTRA for others.
    The words are fixed values."""
    n = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    says = lambda word: F.contains(n, F.lit(word))
    absent = n.startswith("no-") | n.startswith("non-") | n.startswith("without") | says("no-")
    helmet = says("helmet") | says("hardhat") | says("hard-hat")
    person = says("person") | says("worker") | says("people")
    return (
        F.when(helmet & absent, "no-helmet")
        .when(helmet, "helmet")
        .when(says("vest") & absent, "no-vest")
        .when(says("vest"), "vest")
        .when(person, "person")
        .otherwise(EXTRA)
    )


def breach_banner(names: Column, most: int = 3) -> Column:
    """Who is in breach, at most so many, and how many more; empty for none."""
    more = F.size(names) - F.least(F.size(names), F.lit(most))
    head = F.concat(F.size(names).cast("string"), F.lit(" in breach:  "), F.array_join(F.slice(names, 1, most), "   "))
    return F.when(F.size(names) == 0, "").otherwise(F.concat(head, F.when(more > 0, F.concat(F.lit("   +"), more.cast("string"), F.lit(" more"))).otherwise("")))


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def still_id(index: Column, position: Column) -> Column:
    """Ids of untracked stills, unique per image, so that nothing is taken for a repeat."""
    return index * 1000 + position
