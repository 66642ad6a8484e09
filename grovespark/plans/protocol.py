"""Wire formats as values: requests and responses built from and parsed to plain rows. No sockets; a client or server is whoever
carries the bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from grovespark.errors import ProtocolError, RefAdvertisementError, SideBandError
from grovespark.functions.codecs import DELIMITER, FLUSH, pkt_line, side_band, side_band_frames, split_frames
from grovespark.schema import ZERO_OID

#: Have lines in a round of negotiation, and rounds.
HAVES, ROUNDS = 32, 10


def _lines(data: bytes) -> list[tuple[str, str]]:
    return [(kind, p.decode(errors="replace").rstrip("\n")) for kind, p in split_frames(data)[0]]


@dataclass
class Advertisement:
    refs: list[dict] = field(default_factory=list)  # name, oid, peeled, symref_target
    capabilities: dict[str, str | None] = field(default_factory=dict)


def parse_advertisement(data: bytes) -> Advertisement:
    """Version 1: refs with peeled values and capabilities after the first one's NUL."""
    out, peeled, links = Advertisement(), {}, {}
    for kind, line in _lines(data):
        if kind != "data" or line.startswith("# service="):
            continue
        line, nul, caps = line.partition("\0")
        if nul:
            for c in caps.split():
                key, eq, value = c.partition("=")
                if key == "symref" and ":" in value:
                    a, _, b = value.partition(":")
                    links[a] = b
                out.capabilities[key] = value if eq else None
        oid, space, name = line.partition(" ")
        if not space or len(oid) != 40:
            raise RefAdvertisementError(f"no ref: {line}")
        if name == "capabilities^{}":
            continue
        if name.endswith("^{}"):
            peeled[name[:-3]] = oid
        else:
            out.refs.append({"name": name, "oid": oid})
    for r in out.refs:
        r |= {"peeled": peeled.get(r["name"]), "symref_target": links.get(r["name"])}
    return out


def write_advertisement(refs: list[dict], capabilities: list[str], service: str) -> bytes:
    head = pkt_line(f"# service={service}\n") + FLUSH
    rows, out = [(r["oid"], r["name"], r.get("peeled")) for r in refs] or [(ZERO_OID, "capabilities^{}", None)], b""
    for k, (oid, name, peeled) in enumerate(rows):
        out += pkt_line(f"{oid} {name}" + ("\0" + " ".join(capabilities) if k == 0 else "") + "\n")
        if peeled:
            out += pkt_line(f"{peeled} {name}^{{}}\n")
    return head + out + FLUSH


def parse_capabilities(data: bytes) -> dict[str, list[str]]:
    """Version 2: commands and other capabilities with their features."""
    lines = [p for k, p in _lines(data) if k == "data" and not p.startswith("# service=")]
    if not lines or lines[0] != "version 2":
        raise ProtocolError("no version 2")
    return {key: value.split() if eq else [] for key, eq, value in (p.partition("=") for p in lines[1:])}


def write_capabilities(capabilities: dict[str, list[str]]) -> bytes:
    return pkt_line("version 2\n") + b"".join(pkt_line(f"{k}={' '.join(v)}\n" if v else f"{k}\n") for k, v in capabilities.items()) + FLUSH


def write_command(name: str, arguments: list[str], capabilities: list[str] = ()) -> bytes:
    head = pkt_line(f"command={name}\n") + b"".join(pkt_line(f"{c}\n") for c in capabilities)
    return head + (DELIMITER + b"".join(pkt_line(f"{a}\n") for a in arguments) if arguments else b"") + FLUSH


def parse_command(data: bytes) -> tuple[str, list[str], list[str]]:
    """(command, capabilities, arguments)."""
    parts: list[list[str]] = [[], []]
    at = 0
    for kind, line in _lines(data):
        if kind == "delimiter":
            at = 1
        elif kind == "flush":
            break
        else:
            parts[at].append(line)
    if not parts[0] or not parts[0][0].startswith("command="):
        raise ProtocolError("no command")
    return parts[0][0][8:], parts[0][1:], parts[1]


def list_arguments(prefixes: list[str] = (), symrefs: bool = True, peel: bool = True) -> list[str]:
    return ["peel"] * peel + ["symrefs"] * symrefs + [f"ref-prefix {p}" for p in prefixes]


def parse_list_arguments(arguments: list[str]) -> dict:
    return {"peel": "peel" in arguments, "symrefs": "symrefs" in arguments, "prefixes": [a[11:] for a in arguments if a.startswith("ref-prefix ")]}


def parse_listing(data: bytes) -> list[dict]:
    """Rows name, oid, peeled, symref_target of a listing."""
    out = []
    for kind, line in _lines(data):
        if kind != "data":
            continue
        oid, name, *attributes = line.split(" ")
        more = dict(a.split(":", 1) for a in attributes if ":" in a)
        out.append({"name": name, "oid": None if oid == "unborn" else oid, "peeled": more.get("peeled"), "symref_target": more.get("symref-target")})
    return out


def write_listing(rows: list[dict], symrefs: bool = True, peel: bool = True) -> bytes:
    out = b""
    for r in rows:
        line = f"{r['oid']} {r['name']}"
        line += f" symref-target:{r['symref_target']}" if symrefs and r.get("symref_target") else ""
        line += f" peeled:{r['peeled']}" if peel and r.get("peeled") else ""
        out += pkt_line(line + "\n")
    return out + FLUSH


def parse_sizes(data: bytes) -> dict[str, int | None]:
    """oid to size of an object-info response; null for an unknown object."""
    lines = [p for k, p in _lines(data) if k == "data"]
    if lines and lines[0] == "size":
        lines = lines[1:]
    out = {}
    for line in lines:
        oid, _, size = line.partition(" ")
        out[oid] = int(size) if size else None
    return out


def write_sizes(sizes: dict[str, int | None]) -> bytes:
    return pkt_line("size\n") + b"".join(pkt_line(f"{o} {'' if n is None else n}\n") for o, n in sizes.items()) + FLUSH


def fetch_arguments(wants: list[str], haves: list[str] = (), done: bool = False, shallow: list[str] = (), depth: int | None = None, features: list[str] = ()) -> list[str]:
    """What needs a feature of the server (shallow) is left out without it."""
    out = ["ofs-delta", *[f"want {o}" for o in wants], *[f"have {o}" for o in haves]]
    if "shallow" in features:
        out += [f"shallow {o}" for o in shallow] + ([f"deepen {depth}"] if depth else [])
    return out + ["done"] * done


def parse_fetch_arguments(arguments: list[str]) -> dict:
    pick = lambda key: [a[len(key) + 1 :] for a in arguments if a.startswith(f"{key} ")]
    return {"wants": pick("want"), "haves": pick("have"), "shallow": pick("shallow"), "done": "done" in arguments, "ofs_delta": "ofs-delta" in arguments}


def have_rounds(tips: list[str]):
    """Haves in rounds of negotiation; what doesn't fit into ROUNDS rounds isn't offered."""
    for k in range(0, min(len(tips), HAVES * ROUNDS), HAVES):
        yield tips[k : k + HAVES]


def write_acknowledgments(common: list[str], ready: bool) -> bytes:
    return pkt_line("acknowledgments\n") + (b"".join(pkt_line(f"ACK {o}\n") for o in common) or pkt_line("NAK\n")) + (pkt_line("ready\n") if ready else b"")


def write_fetch(pack: bytes, common: list[str] = (), acknowledge: bool = False, shallow: list[str] = (), unshallow: list[str] = ()) -> bytes:
    out = write_acknowledgments(list(common), True) + DELIMITER if acknowledge else b""
    if shallow or unshallow:
        out += pkt_line("shallow-info\n") + b"".join(pkt_line(f"shallow {o}\n") for o in shallow) + b"".join(pkt_line(f"unshallow {o}\n") for o in unshallow) + DELIMITER
    return out + pkt_line("packfile\n") + side_band_frames(pack) + FLUSH


def parse_fetch(data: bytes) -> dict:
    """acknowledged, ready, shallow, unshallow, pack, progress of a fetch response."""
    out = {"acknowledged": [], "ready": False, "shallow": [], "unshallow": [], "pack": b"", "progress": ""}
    section, packed = None, []
    for kind, payload in split_frames(data)[0]:
        if kind != "data":
            section = None
            continue
        if section is None:
            section = payload.decode().rstrip("\n")
            if section not in ("acknowledgments", "shallow-info", "wanted-refs", "packfile"):
                raise ProtocolError(f"an unknown section {section}")
        elif section == "packfile":
            packed.append((kind, payload))
        else:
            key, _, value = payload.decode().rstrip("\n").partition(" ")
            if key == "ACK":
                out["acknowledged"].append(value)
            elif key == "ready":
                out["ready"] = True
            elif key in ("shallow", "unshallow"):
                out[key].append(value)
    if fatal := side_band(packed, 3):
        raise SideBandError(fatal.decode(errors="replace"))
    return out | {"pack": side_band(packed, 1), "progress": side_band(packed, 2).decode(errors="replace")}


def write_push(commands: list[tuple[str, str, str]], pack: bytes, capabilities: list[str]) -> bytes:
    """Commands (old, new, ref), then the pack unless all of them delete."""
    out = b""
    for k, (old, new, ref) in enumerate(commands):
        out += pkt_line(f"{old} {new} {ref}" + ("\0 " + " ".join(capabilities) if k == 0 else "") + "\n")
    return out + FLUSH + (pack if any(new != ZERO_OID for _, new, _ in commands) else b"")


def parse_push(data: bytes) -> tuple[list[tuple[str, str, str]], list[str], bytes]:
    """(commands, capabilities, pack)."""
    commands, capabilities, at = [], [], 0
    while True:
        try:
            n = int(data[at : at + 4], 16)
        except ValueError:
            raise ProtocolError("the commands don't end") from None
        if n == 0:
            return commands, capabilities, data[at + 4 :]
        line, nul, caps = data[at + 4 : at + n].decode().rstrip("\n").partition("\0")
        if nul:
            capabilities = caps.split()
        old, new, ref = line.split(" ", 2)
        commands.append((old, new, ref))
        at += n


def write_report(unpacked: str, statuses: list[tuple[str, str | None]], banded: bool = True) -> bytes:
    """unpack ok (or why not), then ok or ng for each ref."""
    body = pkt_line(f"unpack {unpacked}\n") + b"".join(pkt_line(f"ok {ref}\n" if error is None else f"ng {ref} {error}\n") for ref, error in statuses) + FLUSH
    return side_band_frames(body) + FLUSH if banded else body


def parse_report(data: bytes) -> tuple[str, list[tuple[str, bool, str | None]]]:
    """(unpack status, (ref, ok, message))."""
    frames = split_frames(data)[0]
    if frames and frames[0][1][:1] in (b"\1", b"\2", b"\3"):
        if fatal := side_band(frames, 3):
            raise SideBandError(fatal.decode(errors="replace"))
        frames = split_frames(side_band(frames, 1))[0]
    lines = [p.decode().rstrip("\n") for k, p in frames if k == "data"]
    if not lines or not lines[0].startswith("unpack "):
        raise ProtocolError("no unpack status")
    out = []
    for line in lines[1:]:
        word, _, rest = line.partition(" ")
        ref, _, message = rest.partition(" ")
        if word not in ("ok", "ng"):
            raise ProtocolError(f"an unknown status {line}")
        out.append((ref, word == "ok", message or None))
    return lines[0][7:], out
