"""Reporting a decision as a commit status: a side effect of the driver, behind a transport."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, urlencode

NO_REASONS = "no finding blocks this change"


def post(url: str, params: dict, headers: dict) -> int:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(f"{url}?{urlencode(params)}", headers=headers, method="POST"), timeout=15) as r:
            return r.status
    except HTTPError as problem:
        return problem.code


def post_commit_status(base_url: str, token: str, project_id: str, sha: str, state: str, reasons: list[str], name: str = "lakelens/merge-gate", target_url: str | None = None, send: Callable[[str, dict, dict], int] = post) -> int:
    """The HTTP status of the call. Descriptions are cut to 255 characters."""
    project = quote(project_id, safe="") if "/" in project_id else project_id
    params = {"state": state, "name": name, "description": ("; ".join(reasons) or NO_REASONS)[:255]}
    if target_url:
        params["target_url"] = target_url
    return send(f"{base_url.rstrip('/')}/api/v4/projects/{project}/statuses/{sha}", params, {"PRIVATE-TOKEN": token})
