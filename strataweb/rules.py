"""What is configurable, held as data."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Magic bytes at the start of a body, in order, and their types.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"), (b"wOFF", "font/woff"), (b"wOF2", "font/woff2"), (b"\x00\x01\x00\x00\x00", "font/ttf"), (b"OggS", "application/ogg"),
    (b"RIFF", "application/riff"), (b"\x1f\x8b", "application/gzip"), (b"ID3", "audio/mpeg"),
]
#: Types that an extension stands for.
EXTENSIONS = {
    "html": ["text/html"], "htm": ["text/html"], "css": ["text/css"], "js": ["application/javascript", "text/javascript"], "mjs": ["application/javascript", "text/javascript"],
    "json": ["application/json"], "xml": ["application/xml", "text/xml"], "csv": ["text/csv"], "svg": ["image/svg+xml"], "png": ["image/png"], "jpg": ["image/jpeg"],
    "jpeg": ["image/jpeg"], "gif": ["image/gif"], "webp": ["image/webp"], "ico": ["image/x-icon", "image/vnd.microsoft.icon"], "pdf": ["application/pdf"], "txt": ["text/plain"],
    "woff": ["font/woff"], "woff2": ["font/woff2"], "ttf": ["font/ttf"], "otf": ["font/otf"], "zip": ["application/zip"], "mp3": ["audio/mpeg"], "mp4": ["video/mp4"],
}
#: Content type prefixes and the surfaces their bodies are expanded by, in order.
HANDLERS = [
    ("text/html", "html"), ("text/css", "code"), ("application/javascript", "code"), ("text/javascript", "code"), ("application/json", "json"), ("application/xml", "xml"),
    ("text/xml", "xml"), ("image/svg+xml", "xml"), ("text/csv", "csv"), ("text/plain", "text"), ("text/vtt", "text"),
]
#: Types that the inventory counts as handled.
INVENTORIED = [
    "text/html", "text/css", "application/javascript", "text/javascript", "application/json", "application/manifest+json", "application/xml", "text/xml", "image/svg+xml", "text/csv",
    "text/plain", "text/vtt", "image/png", "image/jpeg", "image/gif", "image/webp", "application/pdf",
]
#: What OCR takes a hexadecimal digit for.
CONFUSIONS = {"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "G": "6", "Z": "2", "z": "2", "q": "9", "g": "9"}
#: The attribution of a tag's reference, by attribute, and by tag and attribute.
ATTRIBUTES = {"href": "a_href", "src": "img_src", "srcset": "srcset", "action": "form_action", "data": "object_data", "poster": "poster"}
TAGS = {
    "a": "a_href", "area": "area_href", "img": "img_src", "script": "script_src", "iframe": "iframe_src", "embed": "embed_src", "object": "object_data", "link": "link_rel",
    "source": "picture_source", "form": "form_action", "track": "track_src", "video": "video_src", "audio": "audio_src",
}
#: Colour and line of a reference in the DOT graph, by attribution; others are black and solid.
HOW_STYLES = {
    "a_href": ("black", "solid"), "img_src": ("gray40", "solid"), "srcset": ("gray40", "dashed"), "picture_source": ("gray40", "dashed"), "css_url": ("darkgreen", "solid"),
    "link_rel": ("darkgreen", "dashed"), "script_src": ("darkorange", "solid"), "iframe_src": ("purple", "solid"), "object_data": ("purple", "solid"), "embed_src": ("purple", "solid"),
    "form_action": ("brown", "solid"), "area_href": ("gray40", "dotted"), "meta_refresh": ("brown", "dashed"), "xhr": ("red", "bold"), "js_navigation": ("red", "solid"),
    "click": ("red", "dotted"), "redirect": ("blue", "dashed"), "header_link": ("blue", "dotted"), "track_src": ("gray40", "dotted"), "video_src": ("gray40", "dotted"),
    "audio_src": ("gray40", "dotted"), "sourcemap": ("darkorange", "dashed"), "http_link_header": ("blue", "dotted"), "json_value": ("darkgreen", "dotted"), "sw_register": ("red", "dashed"),
    "regex_fallback": ("magenta", "bold"), "shadow_dom": ("darkgreen", "bold"), "data_attr": ("gray40", "dotted"), "poster": ("gray40", "solid"),
}
#: Fills of the DOT graph's nodes, by state, by type, and by beginnings of types.
STATE_FILL = {"out_of_scope": "gray85", "errored": "lightpink"}
TYPE_FILL = {"text/css": "khaki", "application/javascript": "khaki", "text/javascript": "khaki"}
PREFIX_FILL = {"text/html": "lightblue", "image/": "palegreen"}
#: Why a hit doesn't count, beside worked examples; the mark of a bare run of digits.
PROSE, BARE, FRAGMENT = "format_prose", "bare_hex_fragment", "FRAGMENT:"
#: Rulings on an image, and the two cases of duplication.
DISAGREEING, FOUND, LOOSE_ONLY, DECOY_ONLY, CLEAN = "needs-review:disagreeing-payloads", "payload-found", "needs-review:loose-only", "ruled-out:decoy-only", "swept-and-clean"
#: Paths that a site declares, whether or not anything links to them.
DECLARED = ["/robots.txt", "/sitemap.xml", "/manifest.json", "/humans.txt", "/.well-known/security.txt", "/favicon.ico"]
#: Types and extensions of bodies whose JSON strings are looked through for links.
JSON_TYPES, JSON_EXTENSIONS = ["application/json", "application/manifest+json"], ["json", "map", "webmanifest"]
SEVERAL_URLS, SEVERAL_REFERRERS = "same_bytes_different_urls", "same_url_multiple_referrers"


@dataclass(frozen=True)
class Rules:
    prefix: str = "MARK"
    #: Canonical values that are worked examples, and the reason.
    excluded: dict[str, str] = field(default_factory=dict)
    prose: str = "hexadecimal"
    blocked: str = "only visible to"
    max_keys: int = 2000
    max_per_template: int = 60
    expected: int = 8
