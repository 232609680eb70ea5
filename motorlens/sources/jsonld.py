"""JSON-LD of pages: the vehicle of a detail page, the adverts of a results page.

Scripts are cut out by an expression. One Arrow function then walks each page's JSON, to any depth (which no Column
expression can), and returns the few nodes that describe adverts as flat structs of what the page says. Reading numbers,
dates and addresses out of that is left to Column expressions. A script that is no JSON is tried again without commas before
closing brackets, then left out; a broken script leaves the others of its page alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.sources.trees import small_batches

# Types of vehicle nodes, the better ones, the keys a node is judged by, and where a results list may hang.
VEHICLES = frozenset(("car", "vehicle", "motorizedvehicle", "product", "offer", "motorcycle"))
CARS = frozenset(("car", "vehicle", "motorizedvehicle"))
KEYS = ("mileageFromOdometer", "vehicleTransmission", "fuelType", "vehicleModelDate", "modelDate", "brand", "model")
HOLDERS = ("mainEntity", "mainEntityOfPage", "about", "hasPart")
SAYING = ("name", "value", "@value", "text")

#: Columns of an entry that are one text; each is the first of these keys that says anything.
SAID = {
    "sku": ("sku", "productID"), "name": ("name", "headline"), "about": ("description",), "brand": ("brand", "manufacturer"), "model_name": ("model",), "trim": ("vehicleConfiguration", "trim"), "paint": ("color",),
    "registered": ("dateVehicleFirstRegistered", "vehicleModelDate", "modelDate", "productionDate"), "dated": ("vehicleModelDate", "modelDate"), "fuel": ("fuelType",), "transmission": ("vehicleTransmission",),
    "vin": ("vehicleIdentificationNumber",), "condition": ("itemCondition",),
}
OTHERS = ("asked", "currency_code", "distance", "distance_unit", "power", "doors_said", "seats_said", "seller_said", "locality", "postal_code", "area", "address")
ENTRY = f"role string, position int, {', '.join(f'{c} string' for c in (*SAID, *OTHERS))}, seller_kinds array<string>, pictures array<string>"
_TYPES = {"role": pa.string(), "position": pa.int32(), **dict.fromkeys((*SAID, *OTHERS), pa.string()), "seller_kinds": pa.list_(pa.string()), "pictures": pa.list_(pa.string())}


def payloads(scripts: list[str]) -> Iterator[object]:
    for script in scripts:
        for text in (script, re.sub(r",\s*([}\]])", r"\1", script)):
            try:
                yield json.loads(text)
                break
            except (ValueError, RecursionError):
                continue


def objects(payload: object) -> Iterator[dict]:
    """All objects of nested lists and graphs, those of a graph before what holds it."""
    todo = [(payload, False)]
    while todo:
        value, opened = todo.pop()
        if isinstance(value, list):
            todo += [(x, False) for x in reversed(value)]
        elif isinstance(value, dict):
            if opened or "@graph" not in value:
                yield value
            else:
                todo += [(value, True), (value["@graph"], False)]


def said(value: object) -> str | None:
    """What a value says: a text itself, the first saying key of an object, the first of a list that says anything."""
    if value.__class__ is str:
        return value.strip() or None
    while isinstance(value, dict):
        value = next((value[k] for k in SAYING if k in value), None)
    if isinstance(value, list):
        return next(filter(None, map(said, value)), None)
    return None if value is None else str(value).strip() or None


def kinds(node: dict) -> list[str]:
    """The schema.org types of a node, in lower case, without their address."""
    found = node.get("@type") or node.get("type") or ""
    return [str(k).rpartition("/")[2].lower() for k in (found if isinstance(found, list) else [found])]


def points(node: dict) -> int:
    """How well a node describes a car; 0 for other things."""
    types = set(kinds(node))
    if not types & VEHICLES:
        return 0
    return 4 * bool(types & CARS) + 2 * bool(node.get("offers")) + sum(bool(node.get(k)) for k in KEYS)


def _object(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _amount(value: object) -> str | None:
    return said(value.get("value")) if isinstance(value, dict) else said(value)


def entry(node: dict, role: str, position: int = 0, address: str | None = None) -> dict:
    offers = node.get("offers")
    offer = _object(offers[0] if isinstance(offers, list) and offers else offers)
    seller = _object(offer.get("seller"))
    place = _object(seller.get("address")) or _object(node.get("address"))
    distance = node.get("mileageFromOdometer") or node.get("mileage")
    pictures = node.get("image") or node.get("photo") or []
    pictures = pictures if isinstance(pictures, list) else [pictures]
    out = dict.fromkeys(SAID)
    for c, keys in SAID.items():
        for k in keys:
            if k in node and (text := said(node[k])):
                out[c] = text
                break
    return out | {
        "role": role, "position": position, "address": address, "asked": said(offer.get("price")) or said(node.get("price")), "currency_code": said(offer.get("priceCurrency")),
        "distance": _amount(distance), "distance_unit": str(_object(distance).get("unitCode") or _object(distance).get("unitText") or ""), "power": _amount(_object(node.get("vehicleEngine")).get("enginePower")),
        "doors_said": _amount(node.get("numberOfDoors")), "seats_said": _amount(node.get("seatingCapacity")), "seller_said": said(seller), "seller_kinds": kinds(seller) if seller else [],
        "locality": said(place.get("addressLocality")), "postal_code": said(place.get("postalCode")), "area": said(place.get("addressRegion")),
        "pictures": [p for p in (said(x.get("url") if isinstance(x, dict) else x) for x in pictures) if p],
    }


def item_list(nodes: list[dict]) -> list:
    """The elements of the results list: of a node that is one, else of the first that hangs on a node."""
    own = next((n for n in nodes if "itemlist" in kinds(n) and n.get("itemListElement")), None)
    if own is None:
        hung = (x for n in nodes for k in HOLDERS for x in (n.get(k) if isinstance(n.get(k), list) else [n.get(k)]))
        own = next((x for x in hung if isinstance(x, dict) and x.get("itemListElement")), {})
    elements = own.get("itemListElement") or []
    return elements if isinstance(elements, list) else [elements]


def entries_of(scripts: list[str], role: str) -> list[dict]:
    nodes = [n for p in payloads(scripts) for n in objects(p)]
    if role == "vehicle":
        best = max(nodes, key=points, default={})  # the first of equals
        return [entry(best, role)] if points(best) else []
    out = []
    for i, element in enumerate(item_list(nodes)):
        if isinstance(element, dict):
            node = element["item"] if isinstance(element.get("item"), dict) else element
            address = said(element.get("url")) or said(node.get("url")) or said(element.get("@id"))
            if address and VEHICLES & set(kinds(node)):
                out.append(entry(node, role, i + 1, address))
    return out


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), 1)


def entries(pages: DataFrame, role: str) -> DataFrame:
    """page and the entries of one role ("vehicle" or "item") of each page (url, html)."""
    small_batches(pages.sparkSession)

    def walk(lists: pa.Array) -> pa.Array:
        rows, first = [], [0]
        for s in lists.to_pylist():
            rows += entries_of(s or [], role)
            first.append(len(rows))
        columns = [pa.array([r[c] for r in rows], t) for c, t in _TYPES.items()]
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(columns, list(_TYPES)))

    run = F.arrow_udf(walk, f"array<struct<{ENTRY}>>")
    # Not a filter, which would be asked before pages are dealt to tasks, with all that html is made of.
    told = F.when(F.col("html").contains("ld+json"), scripts(F.col("html")))
    found = pages.select(F.col("url").alias("page"), run(told).alias("found"))
    # Else pages without entries would be sought first, by a second walk in the tasks that read the table.
    return found.select("page", F.inline_outer("found")).where("role IS NOT NULL").drop("role")
