"""python -m lakesieve.cli: packages in, redacted packages and audits out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakesieve.config import ALL_TYPES, IMAGE_POLICIES, SCOPES, Config
from lakesieve.operators import gazetteer, images
from lakesieve.plans import redactor
from lakesieve.sources import docx, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakesieve")
    p.add_argument("--input", required=True, help="a package, or a folder of packages")
    p.add_argument("--output", help="a table of new packages (path, content)")
    p.add_argument("--map", help="JSON lines of originals and substitutes")
    p.add_argument("--detections", help="JSON lines of all findings")
    p.add_argument("--types", default=",".join(sorted(ALL_TYPES)))
    p.add_argument("--company-scope", choices=SCOPES, default="all")
    p.add_argument("--image-policy", choices=IMAGE_POLICIES, default="none")
    p.add_argument("--image-audit", help="JSON lines of replaced pictures")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-ner", action="store_true")
    p.add_argument("--force", action="store_true", help="also packages that carry the mark of a run")
    p.add_argument("--debug-block", help="print the findings of records whose id or text holds this")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = Config(types=frozenset(args.types.split(",")), company_scope=args.company_scope, seed=args.seed, use_ner=not args.no_ner, image_policy=args.image_policy, force=args.force)
        spark = SparkSession.builder.appName("lakesieve").getOrCreate()
        files = docx.packages(spark, args.input)
        todo = files.where("error IS NULL") if args.force else files.where("error IS NULL AND NOT is_redacted")
        result = redactor.run(docx.records(todo), docx.cells(todo), config)
        redactor.verify(result, gazetteer.vocabulary(docx.records(todo)))
        for row in redactor.counts(result.detections).collect():
            print(f"{row['pii_type']}: {row['n']}")
        if args.debug_block:
            for row in debug(result, args.debug_block).collect():
                print(row["record_id"], row["start"], row["end"], row["pii_type"], row["text"])
        if args.detections:
            tables.write_detections(result.detections, args.detections)
        if args.map:
            tables.write_mapping(result.detections, args.map)
        replaced = None
        if args.image_policy != "none":
            found = docx.pictures(todo).withColumns({c: F.lit(None).cast(k) for c, k in (("ocr_text", "string"), ("has_qr", "boolean"), ("hash", "long"))})
            companies, values = ((result.gazetteer.where("pii_type = 'COMPANY'") if result.gazetteer is not None else result.detections), result.detections)
            audit = images.audit(found, companies, values, args.image_policy)
            if args.image_audit:
                tables.write_images(audit, args.image_audit)
            replaced = audit.select("doc_id", "media_path", F.lit(images.placeholder(64, 64)).alias("new_content"))
        if args.output and not args.dry_run:
            docx.rewrite(todo, result.detections, replaced).write.parquet(args.output)
        for row in files.where("error IS NOT NULL").select("path", "error").collect():
            print(f"{row['path']}: {row['error']}", file=sys.stderr)
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def debug(result: redactor.Result, text: str):  # noqa: ANN201
    """Findings of records whose id or text holds a string, whatever the case."""
    hit = F.lower("record_id").contains(text.lower()) | F.lower("text").contains(text.lower())
    return redactor.spans_of(result.resolved.where(hit))


if __name__ == "__main__":
    sys.exit(main())
