"""Names of the storage layout. A deployment with other names passes its own values to the functions."""

from __future__ import annotations

# Fixed values.
VOLUME = ".cbz"
SIDECAR = ".ocr"
COVER = ".webp"
NO_COVER = ".nocover"
READER_ROOT = "reader"
INBOX = "inbox"
PER_USER_FILES = ("profiles.json", "volume-data.json")
IMAGES = ("jpg", "jpeg", "png", "webp", "gif")
ARCHIVE_IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff")
ARCHIVES = ("cbz", "cbr", "zip", "rar")

ROLES = ("anonymous", "registered", "uploader", "inviter", "editor", "admin")
ROLE_ALIASES = {"writer": "uploader"}
STATUSES = ("active", "pending", "disabled", "deleted")
PERMISSIONS = {
    "anonymous": ("read",),
    "registered": ("read", "write_progress"),
    "uploader": ("read", "write_progress", "add_files"),
    "inviter": ("read", "write_progress", "add_files", "modify_delete", "manage_invites"),
    "editor": ("read", "write_progress", "add_files", "modify_delete"),
    "admin": ("read", "write_progress", "add_files", "modify_delete", "manage_invites", "admin"),
}
DAV_CLIENTS = ("davfs", "cadaver", "cyberduck", "webdav", "gvfs", "nautilus", "finder", "microsoft-webdav", "litmus")
CONTENT_TYPES = {
    ".cbz": "application/vnd.comicbook+zip",
    ".cbr": "application/vnd.comicbook-rar",
    ".zip": "application/zip",
    ".gz": "application/gzip",
    ".json": "application/json",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
}


def sidecars(sidecar: str = SIDECAR) -> tuple[str, str, str, str]:
    """Endings of the files that belong to a volume."""
    return sidecar, f"{sidecar}.gz", COVER, NO_COVER
