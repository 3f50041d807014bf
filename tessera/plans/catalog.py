"""Imports every module that registers queries."""

from tessera.plans import gr, im, kv, pk, zs  # noqa: F401
