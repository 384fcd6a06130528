"""A small index by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

from lumenseek import schema
from lumenseek.index import Index

NOW = datetime(2024, 3, 1, 12, 0, 0)


def hand_made(spark) -> Index:
    at = lambda **d: NOW - timedelta(**d)
    rows = {
        "files": [
            (1, "core", "c1", "README.md", "h1"), (2, "core", "c1", "src/my_file.rs", "h2"), (3, "core", "c2", "src/my_file.rs", "h3"),
            (4, "web", "d1", "app/100%.py", "h2"), (5, "web", "d1", "app/deep/er/x.py", "h4"), (6, "bare", "e1", "a.bin", "h5"),
        ],
        "blobs": [("h1", None, 12, 2), ("h2", "rust", 30, 3), ("h3", "rust", 31, 3), ("h4", "python", 0, 0), ("h5", None, 9, 0)],
        "mapping": [("h1", "k1", 0, 2), ("h2", "k2", 0, 1), ("h2", "k3", 1, 1), ("h2", "k4", 2, 1), ("h3", "k2", 0, 1), ("h3", "k5", 1, 2)],
        "chunks": [("k1", "Alpha\r\nbeta\n"), ("k2", "fn alpha() {\n"), ("k3", "  beta();\n"), ("k4", "}\n"), ("k5", "  gamma é\n}")],
        "symbols": [(1, "h2", "alpha", "alpha"), (2, "h2", "Alpha_beta", "alpha_beta"), (3, "h3", "alphabet", "alphabet"), (4, "h2", "beta", "beta")],
        "namespaces": [(1, ""), (2, "core"), (3, "core::inner")],
        "references": [(1, 1, "definition", 1, 4), (1, 2, "reference", 2, 3), (2, 2, "declaration", 2, 1), (3, 3, "definition", 1, 1), (4, 1, None, 2, 3), (4, 1, "variable_definition", 3, 1)],
        "branches": [("core", "main", "c2", at(days=1)), ("core", "old", "c1", at(days=9)), ("web", "main", "d1", at(days=2))],
        "live": [("core", "main", None)],
        "snapshots": [
            ("core", "main", "c2", at(days=1)), ("core", "main", "s1", at(hours=30)), ("core", "main", "s2", at(days=3)), ("core", "main", "s3", at(days=3, hours=2)), ("core", "main", "s4", at(days=5)),
            ("core", "main", "s5", at(days=40)), ("core", "main", "s6", at(days=-1)), ("core", "old", "s4", at(days=6)), ("web", "main", "d1", at(days=2)), ("web", "main", "w0", at(days=90)),
        ],
        "policies": [("core", "main", 1), ("core", "old", 3), ("web", "main", 0)],
        "snapshot_policies": [("core", "main", 86400, 4), ("core", "main", 604800, 2)],
    }
    schemas = {"files": schema.FILES, "blobs": schema.CONTENT_BLOBS, "mapping": schema.CONTENT_BLOB_CHUNKS, "chunks": schema.CHUNKS, "symbols": schema.SYMBOLS, "namespaces": schema.SYMBOL_NAMESPACES, "references": schema.SYMBOL_REFERENCES, "branches": schema.BRANCHES, "live": schema.LIVE_BRANCHES, "snapshots": schema.BRANCH_SNAPSHOTS, "policies": schema.BRANCH_POLICIES, "snapshot_policies": schema.SNAPSHOT_POLICIES}
    return Index(**{k: spark.createDataFrame(v, schemas[k]) for k, v in rows.items()})
