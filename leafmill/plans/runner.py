"""Running an operator over inputs with failures kept apart, as a plan: one input's error is a row, not the end of the rest."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "input_idx long, path string, output binary, error_type string, message string"


def validate(files: DataFrame, suffixes: Sequence[str], least: int = 1, most: int | None = None) -> DataFrame:
    """files (input_idx, path) with an allowed suffix; wrong ones, or too few or many, are an error."""
    ok = F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).isin([s.lstrip(".").lower() for s in suffixes]) if suffixes else F.lit(True)
    n, bad, first = files.agg(F.count("*"), F.count_if(~ok), F.min(F.when(~ok, F.col("path")))).first()
    if bad:
        raise ValueError(f"{first} is not of {', '.join(suffixes)}")
    if n < least or (most is not None and n > most):
        raise ValueError(f"{n} inputs; {least} to {most or 'any number'} are taken")
    return files


#: What a PDF's objects, packed objects, streams, trailer entries and signatures look like.
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
PACKED = re.compile(rb"/Type\s*/ObjStm\b")
FIRST = re.compile(rb"/First\s+(\d+)")
ENCRYPTED = re.compile(rb"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)")
ROOT = re.compile(rb"/Root\s+(\d+)\s+\d+\s+R")
FIELD = re.compile(rb"/FT\s*/Sig\b")
VALUE = re.compile(rb"/V\s*(?:(\d+)\s+\d+\s+R|(<<))")
SIGNED = re.compile(rb"/(?:ByteRange|Contents)\b")
PERMISSIONS = re.compile(rb"/Perms\s*(?:\d+\s+\d+\s+R|<<)")


def _objects(content: bytes) -> dict[int, bytes]:
    """Number -> object without its stream, those in object streams included; the last of a number counts."""
    found: dict[int, bytes] = {}
    for m in OBJECT.finditer(content):
        body = m[2]
        stream = STREAM.search(body)
        head = body[: stream.start()] if stream else body
        found[int(m[1])] = head
        first = FIRST.search(head) if stream and PACKED.search(head) else None
        if first:
            data = zlib.decompressobj().decompress(stream[1]) if b"FlateDecode" in head else stream[1]
            places = [int(x) for x in data[: int(first[1])].split()]
            ends = [*places[3::2], len(data) - int(first[1])]
            for number, begin, end in zip(places[::2], places[1::2], ends):
                found[number] = data[int(first[1]) + begin : int(first[1]) + end]
    return found


def pdf_state(content: bytes | None) -> str:
    """encrypted, signed, plain, or damaged if it can't be told: no PDF, or a broken one."""
    if not content or b"%PDF-" not in content[:1024]:
        return "damaged"
    if ENCRYPTED.search(STREAM.sub(b"", content)):
        return "encrypted"
    try:
        objects = _objects(content)
    except (zlib.error, ValueError):
        return "damaged"
    roots = ROOT.findall(STREAM.sub(b"", content))
    if not roots or int(roots[-1]) not in objects:
        return "damaged"
    if PERMISSIONS.search(objects[int(roots[-1])]):
        return "signed"
    for body in objects.values():
        value = VALUE.search(body) if FIELD.search(body) else None
        if value and SIGNED.search(objects.get(int(value[1]), b"") if value[1] else body[value.start() :]):
            return "signed"
    return "plain"


def safety(files: DataFrame, encrypted: bool = True, signed: bool = True) -> DataFrame:
    """Adds state and refused to files (path, content): encrypted and signed PDFs, each as asked, and damaged ones, are
    refused, since work on them would drop their protection or break their signature. Other files have no state."""

    @F.pandas_udf("string")
    def state(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pdf_state(None if c is None else bytes(c)))

    wrong = ["damaged", *["encrypted"] * encrypted, *["signed"] * signed]
    marked = files.withColumn("state", F.when(F.lower("path").endswith(".pdf"), state("content")))
    return marked.withColumn("refused", F.coalesce(F.col("state").isin(wrong), F.lit(False)))


def only_safe(files: DataFrame, encrypted: bool = True, signed: bool = True) -> DataFrame:
    """The files, if none is refused by safety(); else an error that names the first, so that no file of a job is worked on."""
    first = safety(files, encrypted, signed).filter("refused").agg(F.min(F.struct("state", "path")).alias("x")).first()["x"]
    if first:
        raise ValueError(f"{first['path']} is {first['state']}")
    return files


def run_each(files: DataFrame, work: Callable[[bytes], bytes]) -> DataFrame:
    """RESULT of work(content) for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, content in zip(b["input_idx"], b["path"], b["content"]):
                try:
                    rows.append((i, path, work(bytes(content)), None, None))
                except Exception as e:
                    rows.append((i, path, None, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["input_idx", "path", "output", "error_type", "message"])

    return files.select("input_idx", "path", "content").mapInPandas(run, RESULT)


def outcome(completed: Column, failed: Column, cancelled: Column) -> Column:
    """success, partial, failure or cancelled of counts."""
    return F.when((cancelled > 0) & (completed == 0), "cancelled").when((failed > 0) | (cancelled > 0), F.when(completed > 0, "partial").otherwise("failure")).otherwise("success")


def summary(results: DataFrame) -> DataFrame:
    done, bad = F.count_if(F.col("error_type").isNull()), F.count_if(F.col("error_type").isNotNull())
    return results.agg(done.alias("completed"), bad.alias("failed"), F.collect_list(F.when(F.col("error_type").isNotNull(), F.struct("path", "error_type", "message"))).alias("errors")).withColumn("outcome", outcome(F.col("completed"), F.col("failed"), F.lit(0)))


#: Places of an order that go to one key where what is known of a name is joined to its rows.
CELL = 100_000


def _told(rows: DataFrame, name: str, place: str, known: DataFrame) -> DataFrame:
    """rows with what is known of their name (known: __of, the name, and more). Rows meet it by name and stretch of CELL places, so
    that a name that very many rows have is dealt over tasks."""
    cell = F.floor(F.col(place) / CELL)
    cells = rows.select(F.col(name).alias("__cn"), cell.alias("__cc")).distinct()
    more = cells.join(known, F.col("__cn") == F.col("__of")).drop("__of")
    return rows.withColumn("__cell", cell).join(more, (F.col(name) == F.col("__cn")) & (F.col("__cell") == F.col("__cc"))).drop("__cell", "__cn", "__cc")


def unique_names(wanted: DataFrame, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Adds unique_name, different for all rows and from all of existing (name).

    A name that doesn't exist goes to the first row, by order, that wants it. Every other row gets the first free number from 1
    on behind its name's stem, rows in order: a number is free if neither existing has the name that it makes nor any row wants
    it. The k-th free number is k and the taken ones up to it, so numbers come from gaps between the taken ones: rows and taken
    numbers are put in one order, by ranges, and a name that very many rows want is no single task's. Rows without a name get
    none; rows of one name and order are in free order."""
    from ..operators.ranks import numbered

    have = (existing.select(F.col("name").alias("__taken")) if existing is not None else wanted.select(F.lit(None).cast("string").alias("__taken")).limit(0)).filter("__taken is not null").distinct()
    asked = numbered(wanted.filter(F.col(name).isNotNull()).select("*", F.monotonically_increasing_id().alias("__id")), [F.col(name), F.col(order), F.col("__id")], "__n").drop("__id")
    first = asked.groupBy(F.col(name).alias("__name")).agg(F.min("__n").alias("__first"))
    first = first.join(have.withColumn("__exists", F.lit(True)), F.col("__name") == F.col("__taken"), "left").select("__name", "__first", F.coalesce("__exists", F.lit(False)).alias("__exists"))
    placed = _told(asked, name, "__n", first.withColumnRenamed("__name", "__of")).withColumn("__name", F.col(name)).withColumn("__k", F.col("__n") - F.col("__first") + F.col("__exists").cast("int"))
    # numbers that are taken, by what stands before and behind them
    every = have.union(first.select("__name")).distinct().select(F.regexp_extract("__taken", "^(.*)_([1-9][0-9]{0,17})(\\.[^.]*)?$", 1).alias("__s"), F.regexp_extract("__taken", "^(.*)_([1-9][0-9]{0,17})(\\.[^.]*)?$", 2).try_cast("long").alias("__t"), F.regexp_extract("__taken", "^(.*)_([1-9][0-9]{0,17})(\\.[^.]*)?$", 3).alias("__x"))
    stem, suffix = F.regexp_replace("__name", "\\.[^.]*$", ""), F.regexp_extract("__name", "(\\.[^.]*)$", 1)
    families = placed.filter("__k > 0").select("__name").distinct().select("__name", stem.alias("__stem"), suffix.alias("__suffix"))
    taken = every.filter("__t is not null").join(families, (F.col("__s") == F.col("__stem")) & (F.col("__x") == F.col("__suffix"))).select("__name", "__t")
    taken = numbered(taken, [F.col("__name"), F.col("__t")], "__n")
    least = taken.groupBy(F.col("__name").alias("__of")).agg(F.min("__n").alias("__begin"))
    # free numbers before the i-th taken one t: t - i; a row whose place is beyond these passes over it
    gaps = _told(taken, "__name", "__n", least).select("__name", (F.col("__t") - (F.col("__n") - F.col("__begin") + 1)).alias("__k"), F.lit(1).alias("__passed"), F.lit(None).cast("long").alias("__row"))
    rows = placed.filter("__k > 0").select("__name", F.col("__k").cast("long").alias("__k"), F.lit(0).alias("__passed"), F.col("__n").alias("__row"))
    both = numbered(rows.unionByName(gaps), [F.col("__name"), F.col("__k"), F.col("__passed"), F.col("__row")], "__place")
    edges = both.groupBy(F.col("__name").alias("__of")).agg(F.min("__place").alias("__begin"))
    passed = _told(both.filter("__passed = 0"), "__name", "__place", edges).select("__row", (F.col("__place") - F.col("__begin") + 1 - F.col("__k")).alias("__over"))
    named = placed.join(passed, F.col("__n") == F.col("__row"), "left")
    number = (F.col("__k") + F.col("__over")).cast("string")
    out = named.withColumn("unique_name", F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), number, suffix)))
    return out.select(*wanted.columns, "unique_name").unionByName(wanted.filter(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string")))


REQUEST_KEYS = {"schema_version", "request_id", "operation", "inputs", "output_dir", "parameters", "options"}


def prepare_request(text: str, most_bytes: int = 1 << 20) -> dict:
    """A JSON request: closed keys, none repeated, a known operation, normalised parameters; passwords are not shown."""
    from ..functions.values import strict_json
    from .catalog import operators

    if len(text.encode()) > most_bytes:
        raise ValueError("the request is too large")
    got = strict_json(text)
    if not isinstance(got, dict):
        raise ValueError("a request is an object")
    if unknown := sorted(set(got) - REQUEST_KEYS):
        raise ValueError("unknown keys: " + ", ".join(unknown))
    op = operators().get(got.get("operation"))
    if op is None:
        raise ValueError(f"no operation {got.get('operation')}")
    if any(re.search(r"(^|[\\/])\.\.([\\/]|$)", str(p)) for p in [*got.get("inputs", []), got.get("output_dir", "")]):
        raise ValueError("paths stay inside their root")
    values = op.normalize(got.get("parameters") or {})
    secret = {p.name for p in op.parameters if p.kind == "password"}
    return got | {"parameters": values, "shown": {k: "***" if k in secret and v else v for k, v in values.items()}}


def first_available(order: Sequence[str], available: Sequence[str], wanted: str = "auto") -> str:
    """An engine: the first of the order that is there; a wanted one never falls back."""
    if wanted != "auto":
        if wanted not in available:
            raise RuntimeError(f"{wanted} is not there")
        return wanted
    found = next((e for e in order if e in available), None)
    if found is None:
        raise RuntimeError("no engine is there")
    return found
