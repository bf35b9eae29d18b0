"""Client addresses behind trusted proxies."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _address(text: str | None):
    try:
        return ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None


def client_ip(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The first forwarded address if the peer is a trusted proxy and that address is one; else the peer.

    Entries of ``trusted`` that are no network are left out.
    """
    nets = []
    for t in trusted:
        try:
            nets.append(ipaddress.ip_network(t.strip(), strict=False))
        except ValueError:
            continue

    @F.pandas_udf("string")
    def pick(peers: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for p, h in zip(peers, heads):
            at, first = _address(p), (h or "").split(",")[0].strip()
            known = at is not None and any(at.version == n.version and at in n for n in nets)
            out.append(first if known and _address(first) is not None else p)
        return pd.Series(out, dtype=object)

    return pick(F.coalesce(peer, F.lit("0.0.0.0")), forwarded)
