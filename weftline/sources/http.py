"""Calls to a service: JSON answers, patience with busy services, and how a collection is cut into pages."""

from __future__ import annotations

import email.utils
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

TIMEOUT = 30
#: Statuses of an item, or of a page, that is not there.
GONE = (404, 410)
#: Statuses that ask to come back later; such a call was not done.
BUSY = (429, 503)
#: How often a busy service is asked again, and how long it is waited for at most each time, in seconds.
RETRIES, LONGEST_WAIT = 5, 60.0
#: Items asked for in a page of a service that lets its callers say.
PAGE_SIZE = 100


@dataclass(frozen=True)
class Answer:
    body: Any
    headers: Any


def unfilled(path: str) -> list[str]:
    """Placeholders that are left in a path; to be checked before a write."""
    return re.findall(r"\{[^}]+\}", path)


def wait_of(said: str | None, attempt: int) -> float:
    """Seconds to wait, of a Retry-After header, a number or a date, or doubling without one."""
    try:
        seconds = float(said) if said is not None and re.fullmatch(r"\s*\d+\s*", said) else email.utils.parsedate_to_datetime(said or "").timestamp() - time.time()
    except (TypeError, ValueError):
        seconds = 0.5 * 2**attempt
    return min(LONGEST_WAIT, max(0.0, seconds))


def call(url: str, method: str = "GET", body: str | None = None, key: str | None = None) -> Answer:
    """The JSON answer. Methods are sent in upper case; the content type is set when there is a body. A busy service is waited for."""
    headers = {} if body is None else {"content-type": "application/json"}
    if key:
        headers["idempotency-key"] = key
    url = urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~{}")  # blanks and letters outside ASCII, as clients do
    for attempt in range(RETRIES + 1):
        request = urllib.request.Request(url, None if body is None else body.encode(), headers, method=method.upper())
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # raises on other than 2xx and redirects
                return Answer(json.loads(answer.read() or b"null"), answer.headers)
        except urllib.error.HTTPError as error:
            if error.code not in BUSY or attempt == RETRIES:
                raise
            time.sleep(wait_of(error.headers.get("retry-after"), attempt))
    raise AssertionError("not reached")


def with_parameters(url: str, given: dict[str, Any]) -> str:
    """url with query parameters set, in place of those of the same name."""
    parts = urllib.parse.urlsplit(url)
    old = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k not in given]
    query = urllib.parse.urlencode([*old, *((k, v) for k, v in given.items() if v is not None)])
    return urllib.parse.urlunsplit(parts._replace(query=query))


def items_of(body: Any) -> list:
    """The items of a page: the array itself, or the one array that an envelope holds."""
    if isinstance(body, list):
        return body
    lists = [v for v in body.values() if isinstance(v, list)] if isinstance(body, dict) else []
    if len(lists) != 1:
        raise ValueError(f"no list of items in an answer of type {type(body).__name__} with {len(lists)} arrays")
    return lists[0]


#: Names by which envelopes give the next page, as a link or as a token.
NEXT = ("next", "next_page", "nextPage", "next_link", "nextLink", "next_url", "next_cursor", "nextCursor", "next_token", "nextToken", "next_page_token", "nextPageToken", "cursor")


def links_of(headers: Any) -> dict[str, str]:
    """Targets of the Link headers by their rel."""
    found = {}
    for line in headers.get_all("link") or []:
        for target, parameters in re.findall(r"<([^>]*)>([^<]*)", line):
            if rel := re.search(r';\s*rel="?([^";,]+)"?', parameters):
                found.update(dict.fromkeys(rel[1].split(), target))
    return found


def next_of(answer: Answer, parameter: str | None) -> dict[str, str] | None:
    """The next page as {"link": ...} or {parameter: token}: of a Link header, or of the envelope, at its top or one level below."""
    if target := links_of(answer.headers).get("next"):
        return {"link": target}
    if not isinstance(answer.body, dict):
        return None
    for level in (answer.body, *(v for v in answer.body.values() if isinstance(v, dict))):
        for name in NEXT:
            found = level.get(name)
            if not isinstance(found, (str, int)) or isinstance(found, bool) or found == "":
                continue
            # a token may hold or begin with a slash: without a parameter for it only links lead on
            if re.match(r"https?://" if parameter else r"https?://|[/?]", str(found)):
                return {"link": str(found)}
            return {parameter: str(found)} if parameter else None
    return None


def chain(url: str, method: str, parameter: str | None) -> Iterator[list]:
    """Pages that each name the next one; a token goes into ``parameter``. A chain that comes back to a page fails."""
    at, seen = url, {url}
    while True:
        answer = call(at, method)
        yield items_of(answer.body)
        found = next_of(answer, parameter)
        if found is None:
            return
        at = urllib.parse.urljoin(at, found["link"]) if "link" in found else with_parameters(url, found)
        if at in seen:
            raise ValueError(f"pages of {url} lead in a circle at {at}")
        seen.add(at)


def page(url: str, method: str) -> tuple[list, Answer | None]:
    """The items of a page; none where it is not there."""
    try:
        answer = call(url, method)
    except urllib.error.HTTPError as error:
        if error.code in GONE:
            return [], None
        raise
    return items_of(answer.body), answer


def count_pages(url_of: Callable[[int], str], method: str, number_of: Callable[[str], int | None]) -> int:
    """How many pages a numbered collection has: what the first page says of the last one, else by doubling and halving.

    url_of: the url of the k-th page from 0 on; number_of: the k of a url. Some 2 log2(pages) calls.
    """
    items, answer = page(url_of(0), method)
    if not items:
        return 1  # also an empty collection is read once
    if answer:
        if (last := links_of(answer.headers).get("last")) and (k := number_of(last)) is not None:
            return k + 1
        if (pages := answer.headers.get("x-total-pages")) and pages.isdigit():
            return max(1, int(pages))
        if (total := answer.headers.get("x-total-count")) and total.isdigit():
            return max(1, -(-int(total) // len(items)))
    there, last, beyond = 0, items, 1

    def further(k: int) -> list:
        """The items of page k, none if it shows a page again, as services do that ignore numbers or stop at their last page."""
        found = page(url_of(k), method)[0]
        return [] if found in (items, last) else found

    while found := further(beyond):
        there, last, beyond = beyond, found, 2 * beyond
    while beyond - there > 1:
        middle = (there + beyond) // 2
        if found := further(middle):
            there, last = middle, found
        else:
            beyond = middle
    if there and page(url_of(there - 1), method)[0] == last:  # what lies beyond the last page shows the last page
        low, there = 0, there - 1
        while there - low > 1:
            middle = (there + low) // 2
            low, there = (low, middle) if page(url_of(middle), method)[0] == last else (middle, there)
    return there + 1
