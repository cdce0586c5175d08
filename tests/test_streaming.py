"""Sync on request through a Structured Streaming query."""

import json
import os

from tessera.sources import derived
from tessera.sources.rules import rules_frame
from tessera.sources.store import VersionedStore
from tessera.sources.tables import Tables
from tessera.streaming.requests import serve_sync_requests

from conftest import SF_SMALL


def _request(folder, rid, force):
    with open(os.path.join(folder, f"{rid}.json"), "w") as f:
        json.dump({"request_id": rid, "force": force}, f)


def test_requests_stream(spark, tmpdir_path):
    t = Tables(spark, SF_SMALL)
    reqs, out = os.path.join(tmpdir_path, "requests"), os.path.join(tmpdir_path, "responses")
    os.makedirs(reqs)
    store = VersionedStore(spark, os.path.join(tmpdir_path, "store"))
    ckpt = os.path.join(tmpdir_path, "stream-ckpt")
    _request(reqs, "r1", False)
    q = serve_sync_requests(spark, reqs, lambda: derived.docs_old(t), rules_frame(spark), store, out,
                            checkpoint_location=ckpt, available_now=True)
    q.awaitTermination(300)
    first = {r["request_id"]: (r["updated"], r["version"]) for r in spark.read.parquet(out).collect()}
    assert first == {"r1": (True, 0)}
    # same listing, no force: nothing to do; a forced request writes a new version
    _request(reqs, "r2", False)
    q = serve_sync_requests(spark, reqs, lambda: derived.docs_old(t), rules_frame(spark), store, out,
                            checkpoint_location=ckpt, available_now=True)
    q.awaitTermination(300)
    _request(reqs, "r3", True)
    q = serve_sync_requests(spark, reqs, lambda: derived.docs_old(t), rules_frame(spark), store, out,
                            checkpoint_location=ckpt, available_now=True)
    q.awaitTermination(300)
    got = {r["request_id"]: (r["updated"], r["version"]) for r in spark.read.parquet(out).collect()}
    assert got == {"r1": (True, 0), "r2": (False, 0), "r3": (True, 1)}
