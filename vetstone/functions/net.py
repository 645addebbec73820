"""Which addresses a probe must never reach."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHARED = [ipaddress.ip_network(x) for x in ("100.64.0.0/10", "198.18.0.0/15", "192.0.0.0/24")]


def reserved(text: str | None) -> bool:
    """Loopback, private, link-local, shared, documentation, multicast and the like; what can't be read counts too."""
    try:
        ip = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return True
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return not ip.is_global or ip.is_multicast or any(ip in n for n in _SHARED if n.version == ip.version)


@F.pandas_udf(T.BooleanType())
def reserved_udf(ip: pd.Series) -> pd.Series:
    return ip.map(reserved)
