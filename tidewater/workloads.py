"""Churn workloads: streams of epochs over small graphs, with their knobs.

Each yields (message, adds, removes) epochs for a program; ``churn`` times them.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from statistics import median

from pyspark.sql import SparkSession

from tidewater.plans.database import Database

Epoch = tuple[str, list[tuple], list[tuple]]

CLOSURE = """
#message add_edge(u64 A, u64 B) @differential.
#local tc(u64 A, u64 B) : add_edge(A, B) : tc(A, X), tc(X, B).
#query from(bound u64 A, free u64 B) : tc(A, B).
"""
CHAIN = """
#message spark(u64 Cell) @differential. #message fuse(u64 Cell, u64 Onward).
#local burning(u64 Cell) : spark(Cell) : burning(Before), fuse(Before, Cell).
#query fire(free u64 Cell) : burning(Cell).
"""
HOPS = """
#message flight(u64 From, u64 To) @differential.
#message one_stop(u64 From, u64 To) @differential : flight(From, Via), flight(Via, To).
"""
DISASSEMBLY = """
#enum Kind u8. #constant Kind FALL 0. #constant Kind JUMP 1. #constant Kind CALL 2.
#message instruction(u64 A). #message transfer(u64 A, u64 B, Kind K).
#local known(u64 A, u64 B, Kind K) : transfer(A, B, K), instruction(A), instruction(B).
#local called(u64 A) : known(_, A, CALL).
#local entry(u64 A) : called(A) : instruction(A), !known(_, A, FALL), !known(_, A, JUMP).
#local inside(u64 F, u64 A) : entry(F), F = A : inside(F, B), known(B, A, FALL), !called(A) : inside(F, B), known(B, A, JUMP), !called(A).
#query function(bound u64 F, free u64 A) : inside(F, A).
"""


def random_churn(nodes: int = 1024, factor: float = 0.8, batch: int = 16, removed: float = 0.5, batches: int = 200, seed: int = 1) -> Iterator[Epoch]:
    """A random graph of nodes * factor edges, then batches of removals and additions."""
    rng = random.Random(seed)
    live = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * factor))}
    yield "add_edge", sorted(live), []
    for _ in range(batches):
        gone = rng.sample(sorted(live), int(batch * removed))
        new = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(batch - len(gone))]
        live = (live - set(gone)) | set(new)
        yield "add_edge", new, gone


def rings(count: int = 8, k: int = 32, batches: int = 20) -> Iterator[Epoch]:
    """Disjoint rings; every batch breaks and mends one of them."""
    yield "add_edge", [(r * k + i, r * k + (i + 1) % k) for r in range(count) for i in range(k)], []
    for n in range(batches):
        edge = ((n // 2 % count) * k, (n // 2 % count) * k + 1)
        yield "add_edge", [edge] * (n % 2), [edge] * (1 - n % 2)


def chain(depth: int = 100_000, cycles: int = 4) -> Iterator[Epoch]:
    """A long chain whose only seed goes and comes."""
    yield "fuse", [(i, i + 1) for i in range(depth)], []
    yield "spark", [(0,)], []
    for _ in range(cycles):
        yield "spark", [], [(0,)]
        yield "spark", [(0,)], []


def flips(nodes: int = 256, m: int = 32, batches: int = 100, seed: int = 2) -> Iterator[Epoch]:
    """Published two-hop pairs under m edge flips a batch."""
    rng, live = random.Random(seed), set()
    for _ in range(batches):
        flip = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(m)} | set(rng.sample(sorted(live), min(len(live), m // 2)))
        yield "flight", sorted(flip - live), sorted(flip & live)
        live ^= flip


def disassembly(blocks: int = 2000, size: int = 64, seed: int = 3) -> Iterator[Epoch]:
    """Growth only: instructions and their transfers, some of them calls."""
    rng, at = random.Random(seed), 0
    for _ in range(blocks // size):
        yield "instruction", [(at + i,) for i in range(size)], []
        yield "transfer", [(at + i, at + i + 1, 0) for i in range(size - 1)] + [(at + rng.randrange(size), rng.randrange(at + size), rng.choice((1, 2))) for _ in range(size // 8)], []
        at += size


WORKLOADS = {
    "tc_random": (CLOSURE, random_churn), "pure_cycle": (CLOSURE, rings), "deep_chain": (CHAIN, chain),
    "flip_storm": (HOPS, flips), "disasm_synth": (DISASSEMBLY, disassembly)}


def churn(spark: SparkSession, name: str, **knobs) -> dict[str, float]:
    """Run a workload: seconds in total and of the median epoch after the first three."""
    program, make = WORKLOADS[name]
    db, took = Database(program, spark).init(), []
    for message, adds, removes in make(**knobs):
        began = time.perf_counter()
        db.send(message, adds, removes or None)
        took.append(time.perf_counter() - began)
    return {"total_s": sum(took), "epoch_s": median(took[3:] or took), "epochs": len(took)}
