"""Command line: ``validate`` specs, ``transform`` raw events, ``package`` the library for a cluster."""

from __future__ import annotations

import argparse
import importlib
import sys
import zipfile
from pathlib import Path

import yaml

from strandline.plans.spec import load_raw, tag
from strandline.plans.validate import SpecError, validate


def _checked(path: str) -> bool:
    print(f"Running validation on {path}")
    try:
        validate(load_raw(path))
    except yaml.YAMLError:
        print("Invalid yaml", file=sys.stderr)
        return False
    except (SpecError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return False
    print("Document is valid")
    return True


def discover(folder: Path) -> tuple[str | None, str | None]:
    """The first streaming and the first window spec among the folder's YAML files."""
    found: dict[str, str] = {}
    for p in sorted([*folder.glob("*.yml"), *folder.glob("*.yaml")]):
        try:
            kind = tag(load_raw(p).get("Type"))
        except (yaml.YAMLError, ValueError):
            continue
        found.setdefault(kind, str(p))
    return found.get("transform:streaming"), found.get("transform:window")


def _own_processor(name: str):
    """A processor of the user's own, ``package.module:function``, which takes a session and paths and returns a DataFrame."""
    module, _, function = name.partition(":")
    sys.path.insert(0, str(Path.cwd()))
    try:
        return getattr(importlib.import_module(module), function, None)
    except ImportError as e:
        print(e, file=sys.stderr)
        return None
    finally:
        sys.path.pop(0)


def transform(args: argparse.Namespace) -> int:
    from strandline import sinks
    from strandline.plans.engine import Engine
    from strandline.session import local_session
    from strandline.sources.readers import PROCESSORS

    stream, window = args.streaming, args.window
    if stream is None and window is None:
        stream, window = discover(Path.cwd())
    if stream is None:
        print("No streaming spec was given or found in the current directory.", file=sys.stderr)
        return 1
    processor = PROCESSORS.get(args.processor)
    if processor is None and ":" in args.processor:
        processor = _own_processor(args.processor)
    if processor is None:
        print(f"Unknown data processor: '{args.processor}'. Possible values: {list(PROCESSORS)}, or package.module:function", file=sys.stderr)
        return 1
    if args.runner not in ("local", "spark"):
        print(f"Unknown runner: '{args.runner}'. Possible values: ['local', 'spark']", file=sys.stderr)
        return 1
    if args.runner == "local":
        spark = local_session()
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    engine = Engine(stream, window, once=True)
    events = processor(spark, [p for x in args.source for p in x.split(",")])
    made = engine.blocks(events, "_order" if "_order" in events.columns else None)
    if window is None:
        for name, df in made.items():
            for line in sinks.lines(sinks.block_lines(df, engine.stream.aggregate(name)).orderBy("value")):
                print(line)
        if args.output:
            sinks.write_blocks(made, {a.name: a for a in engine.stream.aggregates}, args.output)
    else:
        features = engine.windowed(made)
        identities = None
        for df in made.values():
            ids = df.select("_identity")
            identities = ids if identities is None else identities.unionByName(ids)
        for line in sinks.lines(sinks.feature_lines(features, identities).orderBy("value")):
            print(line)
        if args.output:
            sinks.write_features(features, args.output)
    return 0


def package(target: str) -> int:
    """The library as a zip for ``spark-submit --py-files``."""
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate", help="check specs")
    v.add_argument("specs", nargs="*", help="YAML files; all of the current directory by default")
    t = commands.add_parser("transform", help="run specs over raw events")
    t.add_argument("--runner", default="local")
    t.add_argument("--streaming")
    t.add_argument("--window")
    t.add_argument("--processor", default="simple")
    t.add_argument("--output", help="folder to write to as well")
    t.add_argument("source", nargs="+", help="files or patterns, also separated by commas")
    p = commands.add_parser("package", help="zip the library for a cluster")
    p.add_argument("target")
    args = parser.parse_args(argv)
    if args.command == "validate":
        specs = args.specs or [str(p) for p in sorted([*Path.cwd().glob("*.yml"), *Path.cwd().glob("*.yaml")])]
        return int(not all([_checked(s) for s in specs]))
    return transform(args) if args.command == "transform" else package(args.target)
