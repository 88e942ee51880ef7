"""Tenant scope: the only way a multi-tenant table is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TENANT = "default"
# Fixed pattern of a tenant id.
TENANT_PATTERN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}")


class TenantScopeError(ValueError):
    """A read that could leak another tenant's rows."""


def tenant_scope(df: DataFrame, tenant: str | None, column: str = "tenant_id", keep: bool = False) -> DataFrame:
    """Rows of one tenant, without the tenant column unless it is to be kept. A row without a tenant belongs to the default one.

    With no tenant the read is allowed only while the table holds nothing but the default tenant;
    one row of any other tenant makes it fail.
    """
    if column not in df.columns:
        raise TenantScopeError(f"table has no {column} column")
    if tenant is None:
        if not df.filter(F.coalesce(F.col(column), F.lit(DEFAULT_TENANT)) != DEFAULT_TENANT).limit(1).isEmpty():
            raise TenantScopeError("an unscoped read of a multi-tenant table is not allowed")
        return df if keep else df.drop(column)
    if not isinstance(tenant, str) or not TENANT_PATTERN.fullmatch(tenant):
        raise TenantScopeError("invalid tenant id")
    own = df.filter(F.coalesce(F.col(column), F.lit(DEFAULT_TENANT)) == tenant)
    return own if keep else own.drop(column)
