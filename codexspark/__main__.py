"""Command line: python -m codexspark COMMAND PATH [-o FOLDER].

Commands read all containers below PATH. summary, headers, records and exth show tables (or write them as Parquet with
-o); text, dump, parts, epub, cover and source write a file for each result; meta edits metadata and writes containers.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexspark.operators import metadata, resources, rewrite
from codexspark.plans.reconstruct import Collection
from codexspark.sources import containers as C
from codexspark.sources import reader
from codexspark.sources.files import write_files, write_joined

TABLES = ("summary", "headers", "records", "exth", "toc")
FILES = ("text", "dump", "parts", "epub", "cover", "source")


def tables(book: Collection, command: str) -> DataFrame:
    if command == "records":
        return book.all_records.drop("data")
    if command == "headers":
        return book.headers.drop("data", "full_name")
    return {"summary": lambda: book.summary, "exth": lambda: book.decoded_tags, "toc": lambda: book.toc}[command]()


def files(book: Collection, command: str) -> DataFrame:
    """(file_name, data); names begin with the document's number."""
    own = lambda rows, name, data="data": rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), name).alias("file_name"), F.col(data).alias("data")).filter("data is not null")
    if command == "text":
        return own(book.text, F.lit("text.rawml"), "text")
    if command == "dump":
        return own(book.all_records, F.format_string("record_%d_uid_%d", F.col("seq").cast("long"), F.col("rec_uid")))
    if command == "parts":
        return own(book.file_table, F.col("file_name"))
    if command == "cover":
        rows = reader.covers(book.opened).join(F.broadcast(resources.kinds(book.files.sparkSession)), "kind", "left")
        return own(rows, F.concat(F.lit("cover."), F.coalesce("extension", F.lit("raw"))))
    found = reader.embedded(book.opened)
    kind = F.when(F.substring("source", 31, 28) == F.lit(b"mimetypeapplication/epub+zip"), "epub").otherwise("zip")
    return own(found, F.concat(F.lit("source."), kind), "source").unionByName(own(found.withColumn("log", F.col("log")), F.lit("log.txt"), "log"))


def edited(book: Collection, actions: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, content) after actions (add|set|delete, FIELD=VALUE or TAG=VALUE), in order, on all halves."""
    steps = []
    for kind, what in actions:
        name, _, value = what.partition("=")
        steps.append(rewrite.action(kind, metadata.FIELDS[name] if name in metadata.FIELDS else int(name), F.lit(value)))
    return rewrite.edited(book.files, *steps)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codexspark", description=__doc__)
    p.add_argument("command", choices=(*TABLES, *FILES, "meta"))
    p.add_argument("path")
    p.add_argument("-o", "--out")
    p.add_argument("-7", "--older", action="store_true", help="read the older half of hybrids")
    for flag, action in (("-a", "add"), ("-s", "set"), ("-d", "delete")):
        p.add_argument(flag, f"--{action}", dest="actions", action="append", type=lambda x, a=action: (a, x), metavar="FIELD[=VALUE]")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    book = Collection(C.scan(spark, args.path).select("doc_id", "content"), "older" if args.older else "newer")
    if args.command in TABLES:
        out = tables(book, args.command)
        out.write.mode("overwrite").parquet(args.out) if args.out else out.show(50, truncate=40)
    elif not args.out:
        raise SystemExit("-o FOLDER is needed")
    else:
        if args.command == "epub":  # part by part: an archive is never held whole
            name = F.concat(F.col("doc_id").cast("string"), F.lit("_book.epub"))
            n, size = write_joined(book.epub_parts.select(name.alias("file_name"), "place", "data"), args.out)
            print(f"{n} files, {size} bytes")
            return 0
        rows = edited(book, args.actions or []).select(F.concat(F.col("doc_id").cast("string"), F.lit(".mobi")).alias("file_name"), F.col("content").alias("data")) if args.command == "meta" else files(book, args.command)
        n, size = write_files(rows, args.out)
        print(f"{n} files, {size} bytes")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
