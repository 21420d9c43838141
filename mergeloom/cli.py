"""Command line: python -m mergeloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

import numpy as np

from mergeloom.artifact import BYTE_COUNT, BYTE_FALLBACK, PACK_NAMES, Artifact, read_artifact, write_new
from mergeloom.errors import DecodeError, MergeloomError
from mergeloom.functions.automaton import expansions, rank_passes
from mergeloom.functions.packed import Expander, PackedAutomaton
from mergeloom.functions.routing import span_borders

#: Merges shown by inspect-merges unless told otherwise.
SHOWN = 50


def encode(artifact: Artifact | None, data: bytes) -> list[str]:
    """Token ids as printed: bare numbers for a flat model, NAME:local for packs, 65535:b without a model."""
    if artifact and artifact.flat:
        return [str(t) for t in rank_passes(np.frombuffer(data, np.uint8), np.array(artifact.flat.merges, np.int32).reshape(-1, 3))]
    if artifact and artifact.packed:
        pack, local, _ = PackedAutomaton(_packs(artifact)).tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([_utf8(data)]))
        return [f"{PACK_NAMES[int(p)]}:{int(x)}" for p, x in zip(pack, local)]
    return [f"{BYTE_FALLBACK}:{b}" for b in data]


def _packs(a: Artifact) -> dict[int, list[tuple[int, int, int]]]:
    return {p.pack_id: [(x, y, BYTE_COUNT + r) for r, (x, y) in enumerate(p.merges)] for p in a.packed.packs} if a.packed else {}


def _utf8(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def parse(token: str, artifact: Artifact | None) -> tuple[int, int]:
    """(pack, local) of a printed id; a pack's name goes before its number."""
    if artifact and artifact.flat and ":" not in token:
        return 0, int(token)
    parts = token.split(":")
    if len(parts) != 2:
        raise DecodeError("malformed token", token=token)
    names = {p.name: p.pack_id for p in artifact.registry.packs} if artifact else {PACK_NAMES[BYTE_FALLBACK]: BYTE_FALLBACK}
    try:
        return names[parts[0]] if parts[0] in names else int(parts[0]), int(parts[1])
    except ValueError:
        raise DecodeError("malformed token", token=token) from None


def decode(artifact: Artifact | None, tokens: list[str]) -> bytes:
    ids = np.array([parse(t, artifact) for t in tokens], np.int64).reshape(-1, 2)
    table = Expander.flat(list(artifact.flat.merges)) if artifact and artifact.flat else Expander.packed(_packs(artifact) if artifact else {})
    return table.expand(table.codes(ids[:, 0], ids[:, 1]), np.array([0, len(ids)]))[0].tobytes()


def _shown(symbol: int) -> str:
    return f"BYTE({symbol})" if symbol < BYTE_COUNT else f"LOCAL({symbol - BYTE_COUNT})"


def inspect(a: Artifact) -> list[str]:
    out = [f"version: {a.version}", f"fallback: {a.registry.fallback}", f"packs: {len(a.registry.packs)}", f"special tokens: {len(a.registry.specials)}", f"metadata entries: {len(a.metadata)}"]
    if a.flat:
        out.append(f"merges: {len(a.flat.merges)}")
    if a.packed:
        out += [f"router: {a.packed.router}"] + [f"merges of {PACK_NAMES[p.pack_id]}: {len(p.merges)}" for p in a.packed.packs]
    return out


def token_info(a: Artifact, token: str) -> list[str]:
    pack, local = parse(token, a)
    if a.flat:
        table, ids = expansions(a.flat.merges), local
        parents = a.flat.merges[local - BYTE_COUNT][:2] if local >= BYTE_COUNT and local in table else None
    else:
        merges = _packs(a).get(pack, [])
        table = expansions(merges)
        ids = local if pack == BYTE_FALLBACK else BYTE_COUNT + local
        parents = merges[local][:2] if pack != BYTE_FALLBACK and 0 <= local < len(merges) else None
    if ids not in table or (pack == BYTE_FALLBACK and local >= BYTE_COUNT):
        raise DecodeError("unknown token", pack=pack, local=local)
    raw = table[ids]
    out = [f"token: {PACK_NAMES.get(pack, 'UNKNOWN_PACK') if not a.flat else 'FLAT_BPE'}:{local}", f"bytes: {len(raw)}", f"hex: {raw.hex()}"]
    return out + ([f"parents: {_shown(parents[0])} {_shown(parents[1])}"] if parents else [])


def merge_lines(a: Artifact, limit: int = SHOWN) -> list[str]:
    rows = [(0, r, m[0], m[1]) for r, m in enumerate(a.flat.merges)] if a.flat else [(p, r, m[0], m[1]) for p, ms in _packs(a).items() for r, m in enumerate(ms)]
    lines = [f"{'FLAT_BPE' if a.flat else PACK_NAMES[p]} {r}: {_shown(x)} {_shown(y)}" for p, r, x, y in rows[:limit]]
    return lines + ([f"({limit} of {len(rows)})"] if len(rows) > limit else [])


def _train(args, packs: bool) -> int:
    from mergeloom.operators import train
    from mergeloom.session import local_session
    from mergeloom.sources.files import load_corpus, provenance
    from pyspark.sql import functions as F

    spark = local_session()
    corpus = load_corpus(spark, args.corpus)
    cfg = train.TrainingConfig(args.target_vocab_size, args.max_merges if args.max_merges is not None else args.target_vocab_size - BYTE_COUNT, args.min_pair_frequency)
    origin = provenance(corpus, args.corpus.replace("\\", "/")).head()
    facts = (cfg, origin.files, origin.total_bytes, int(origin.fnv1a64, 16), origin.input)
    if packs:
        text = corpus.select(F.validate_utf8(F.col("content").cast("string")).alias("text"))
        model = train.train_packs(text, "text", cfg)
        artifact = train.packed_artifact(model, train.training_stats(text, "text", model).collect(), *facts)
    else:
        artifact = train.flat_artifact(train.train_flat(corpus, "content", cfg, order=("ord",)), *facts)
    write_new(args.artifact, artifact.to_bytes())
    print("\n".join(inspect(artifact)))
    return 0


def _corpus(args) -> int:
    from mergeloom.plans import corpus_build
    from mergeloom.session import local_session
    from mergeloom.sources.files import load_corpus

    spark = local_session()
    if args.command == "corpus":
        got = corpus_build.write_corpus(load_corpus(spark, args.files).withColumnRenamed("rel_path", "name"), args.folder, args.mode, args.block_bytes)
        print("\n".join(f"{s}: {v['blocks']} blocks, {v['bytes']} bytes, {v['dropped']} dropped" for s, v in sorted(got["splits"].items())))
        return 0
    if args.command == "prepare":
        rows = corpus_build.prepare(spark, args.folder, read_artifact(args.artifact))
        print(f"sequences: {rows.count()}")
        return 0
    if args.command == "verify-prepared":
        bad = corpus_build.verify_prepared(spark, args.folder).limit(SHOWN).collect()
        print("\n".join(f"{r.path}: {r.problem}" for r in bad) or "verified")
        return int(bool(bad))
    for r in corpus_build.plan(spark, args.folder).orderBy("split").collect():  # three rows
        print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="mergeloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode"):
        c = sub.add_parser(name)
        c.add_argument("--artifact")
        c.add_argument("values", nargs="*")
    c = sub.add_parser("route")
    c.add_argument("values", nargs="*")
    for name in ("init", "validate", "inspect", "stats"):
        sub.add_parser(name).add_argument("artifact")
    for name in ("train-bpe", "train-packs"):
        c = sub.add_parser(name)
        c.add_argument("corpus")
        c.add_argument("artifact")
        c.add_argument("--target-vocab-size", type=int, default=512)
        c.add_argument("--max-merges", type=int)
        c.add_argument("--min-pair-frequency", type=int, default=2)
    for name in ("inspect-token", "inspect-pack"):
        c = sub.add_parser(name)
        c.add_argument("artifact")
        c.add_argument("value")
    c = sub.add_parser("inspect-merges")
    c.add_argument("artifact")
    c.add_argument("--limit", type=int, default=SHOWN)
    c = sub.add_parser("corpus")
    c.add_argument("files")
    c.add_argument("folder")
    c.add_argument("--mode", choices=("near", "passages"), default="near")
    c.add_argument("--block-bytes", type=int)
    c = sub.add_parser("prepare")
    c.add_argument("folder")
    c.add_argument("artifact")
    for name in ("verify-prepared", "plan"):
        sub.add_parser(name).add_argument("folder")
    args = top.parse_args(argv)
    try:
        return _run(args)
    except (MergeloomError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(args) -> int:
    if args.command in ("encode", "decode"):
        a = read_artifact(args.artifact) if args.artifact else None
        if args.command == "encode":
            print(" ".join(encode(a, " ".join(args.values).encode())))
        else:
            sys.stdout.buffer.write(decode(a, " ".join(args.values).split()))
            sys.stdout.buffer.flush()
    elif args.command == "route":
        data = np.frombuffer(" ".join(args.values).encode(), np.uint8)
        packs, border = span_borders(data, np.array([0, len(data)]))
        at = np.flatnonzero(border)
        for s, e in zip(at, [*at[1:], len(data)]):
            print(f"{PACK_NAMES[int(packs[s])]} {s}..{e} {data[s:e].tobytes().decode()!r}")
    elif args.command == "init":
        write_new(args.artifact, Artifact.bytes_only().to_bytes())
    elif args.command in ("train-bpe", "train-packs"):
        return _train(args, args.command == "train-packs")
    elif args.command in ("corpus", "prepare", "verify-prepared", "plan"):
        return _corpus(args)
    else:
        a = read_artifact(args.artifact)
        if args.command == "validate":
            print("valid")
        elif args.command == "inspect":
            print("\n".join(inspect(a)))
        elif args.command == "stats":
            print("\n".join(f"{k}={v}" for k, v in sorted(a.metadata.items()) if k.startswith(("m2.", "corpus.", "experiment."))))
        elif args.command == "inspect-token":
            print("\n".join(token_info(a, args.value)))
        elif args.command == "inspect-merges":
            print("\n".join(merge_lines(a, args.limit)))
        elif args.command == "inspect-pack":
            pack = next((p for p in a.registry.packs if args.value in (p.name, str(p.pack_id))), None)
            if pack is None:
                raise DecodeError("unknown pack", pack=args.value)
            print(f"{pack.pack_id} {pack.name} {pack.local_token_count}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
