"""Schemas of the input relations; nothing is inferred."""

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _T = T.StringType(), T.LongType(), T.TimestampNTZType()

FILES = _of(rel_path=_S, size=_L, mtime=_L)
USERS = _of(id=_L, username=_S, role=_S, status=_S, notes=_S, created_at=_T, updated_at=_T)
INVITES = _of(id=_L, code=_S, role=_S, invited_by=_S, created_at=_T, expires_at=_T, used_by=_S, used_at=_T)
AUDIT = _of(id=_L, actor_username=_S, action=_S, target_type=_S, target_path=_S, target_username=_S, details=_S, created_at=_T)
UPLOADS = _of(volume_key=_S, uploader_username=_S, uploaded_at=_T, last_modified_by=_S, last_modified_at=_T)
PROGRESS = _of(active=T.BooleanType(), series=_S, volume=_S, relative_cbz=_S, percent=T.IntegerType(), eta_seconds=_L, done_pages=_L, total_pages=_L, status=_S, started_at=T.DoubleType(), updated_at=T.DoubleType())
REQUESTS = _of(request_id=_L, method=_S, path=_S, username=_S, auth_state=_S)
ATTEMPTS = _of(key=_S, ts=_T, outcome=_S)
FILE_EVENTS = _of(path=_S, kind=_S, ts=T.TimestampType())
