"""Both ends of an exchange of messages: services that answer requests from a repository's tables, and clients that are given a
way to carry bytes. No sockets: a transport is a function (service, request) -> response.

A listing and a negotiation are short. A pack is one file by its format: a task writes it to the shared folder, or reads it
from there, and the driver passes its bytes on as they are. Whole tables are better exchanged with Repository.fetch() and push().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.catalog import Repository
from grovespark.errors import InvalidObjectError, ProtocolError, PushError, TransactionError
from grovespark.functions.names import RefSpec
from grovespark.operators import graph
from grovespark.operators import refs as R
from grovespark.plans import protocol, pushing
from grovespark.schema import REMOTE_REFS, ZERO_OID
from grovespark.sources import datasource, writers
from grovespark.storage import Scratch, shared_folder

UPLOAD, RECEIVE = "git-upload-pack", "git-receive-pack"
Transport = Callable[[str, bytes], bytes]


def _folder(repo: Repository) -> str:
    return f"{shared_folder(repo.spark)}/grovespark/exchange-{uuid.uuid4().hex}"


def _ids(repo: Repository, oids) -> DataFrame:
    return repo.spark.createDataFrame([(o,) for o in oids], "oid string")


def pack_bytes(repo: Repository, oids: DataFrame) -> bytes:
    """The objects with these ids as a pack; no bytes without any."""
    folder = _folder(repo)
    rows = repo.objects.join(oids.select("oid").distinct(), "oid", "left_semi")
    made = writers.write_packs(rows.select(F.lit(0).alias("pack"), F.col("oid").alias("seq"), "type", "content"), folder).collect()
    return writers.read_file(f"{folder}/{made[0]['name']}") if made else b""


def unpacked(repo: Repository, pack: bytes) -> DataFrame:
    """(oid, type, size, content) of a pack's objects; InvalidObjectError for a damaged one."""
    folder = _folder(repo)
    datasource.register(repo.spark)
    writers.put_file(f"{folder}/received.pack", pack)
    rows = Scratch(repo.spark).keep(repo.spark.read.format("repo_pack").load(folder))
    bad = rows.where("error IS NOT NULL").first()
    if bad:
        raise InvalidObjectError(bad["error"])
    return rows.select("oid", "type", F.octet_length("content").cast("bigint").alias("size"), "content")


class UploadPackService:
    """Answers requests of version 2: ls-refs, object-info and fetch."""

    def __init__(self, repo: Repository):
        self.repo = repo

    def advertise(self) -> bytes:
        return protocol.write_capabilities({"agent": ["grovespark"], "ls-refs": [], "fetch": ["shallow"], "object-info": ["size"]})

    def handle(self, request: bytes) -> bytes:
        command, _, arguments = protocol.parse_command(request)
        answer = {"ls-refs": self._list, "object-info": self._sizes, "fetch": self._fetch}.get(command)
        if answer is None:
            raise ProtocolError(f"an unknown command {command}")
        return answer(arguments)

    def _list(self, arguments: list[str]) -> bytes:
        asked = protocol.parse_list_arguments(arguments)
        rows = R.list_refs(self.repo.advertised(), asked["prefixes"]).collect()
        return protocol.write_listing([r.asDict() for r in rows], asked["symrefs"], asked["peel"])

    def _sizes(self, arguments: list[str]) -> bytes:
        wanted = [a.removeprefix("oid ") for a in arguments if a.startswith("oid ")]
        known = {r["oid"]: r["size"] for r in self.repo.objects.join(_ids(self.repo, wanted).distinct(), "oid", "left_semi").select("oid", "size").collect()}
        return protocol.write_sizes({o: known.get(o) for o in wanted})

    def _fetch(self, arguments: list[str]) -> bytes:
        """Acknowledgments alone while nothing is in common and the client has more to offer; the pack otherwise."""
        asked, repo = protocol.parse_fetch_arguments(arguments), self.repo
        absent = _ids(repo, asked["wants"]).join(repo.objects.select("oid"), "oid", "left_anti").first()
        if absent or not asked["wants"]:
            raise ProtocolError(f"no object {absent['oid']}" if absent else "nothing is wanted")
        shared = graph.common(_ids(repo, asked["haves"]), repo.objects)
        common = sorted(r["oid"] for r in shared.collect())
        if not common and not asked["done"]:
            return protocol.write_acknowledgments([], False) + protocol.FLUSH
        boundary = repo.shallow.union(_ids(repo, asked["shallow"])).distinct()
        sent = graph.to_send(repo.edges(), _ids(repo, asked["wants"]), shared, boundary)
        return protocol.write_fetch(pack_bytes(repo, sent), common, not asked["done"], [r["oid"] for r in repo.shallow.orderBy("oid").collect()])


class ReceivePackService:
    """Takes a push: `repo` is the repository after all requests so far."""

    CAPABILITIES = ("report-status", "delete-refs", "ofs-delta", "atomic")

    def __init__(self, repo: Repository):
        self.repo = repo

    def advertise(self) -> bytes:
        rows = [r.asDict() for r in self.repo.advertised().where("name <> 'HEAD'").collect()]
        return protocol.write_advertisement(rows, list(self.CAPABILITIES), RECEIVE)

    def handle(self, request: bytes) -> bytes:
        commands, capabilities, pack = protocol.parse_push(request)
        there = self.repo
        if pack:
            try:
                there = there.add_table(unpacked(there, pack)).settled()
            except InvalidObjectError as error:
                return protocol.write_report(str(error), [(ref, "nothing was unpacked") for _, _, ref in commands])
        sent = there.spark.createDataFrame(commands, "old_oid string, new_oid string, ref string")
        checked = Scratch(there.spark).keep(pushing.check_updates(sent, there.refs, there.objects))
        errors = {r["ref"]: r["error"] for r in checked.collect()}
        atomic = "atomic" in capabilities
        if atomic and any(errors.values()):
            errors = {ref: error or "another one failed" for ref, error in errors.items()}
        self.repo = replace(there, refs=pushing.apply_commands(checked, there.refs, atomic)).settled()
        return protocol.write_report("ok", [(ref, errors[ref]) for _, _, ref in commands])


def transport_of(upload: UploadPackService | None = None, receive: ReceivePackService | None = None) -> Transport:
    """The way to services in this process. An empty request asks for the advertisement."""

    def carry(service: str, request: bytes) -> bytes:
        end = {UPLOAD: upload, RECEIVE: receive}.get(service)
        if end is None:
            raise ProtocolError(f"no service {service}")
        return end.handle(request) if request else end.advertise()

    return carry


def list_remote(repo: Repository, transport: Transport, prefixes: list[str] = ()) -> DataFrame:
    """(name, oid, peeled, symref_target) of a remote's references."""
    rows = protocol.parse_listing(transport(UPLOAD, protocol.write_command("ls-refs", protocol.list_arguments(list(prefixes)))))
    return repo.spark.createDataFrame([(r["name"], r["oid"], r["peeled"], r["symref_target"]) for r in rows], REMOTE_REFS)


def remote_sizes(transport: Transport, oids: list[str]) -> dict[str, int | None]:
    """Sizes of a remote's objects; null for one that it hasn't got."""
    return protocol.parse_sizes(transport(UPLOAD, protocol.write_command("object-info", ["size", *[f"oid {o}" for o in oids]])))


def fetch_objects(repo: Repository, transport: Transport, wants: list[str]) -> Repository:
    """repo with what `wants` need: haves are offered in rounds until the server is ready, then the pack is unpacked."""
    features = protocol.parse_capabilities(transport(UPLOAD, b"")).get("fetch", [])
    tips = sorted({r["oid"] for r in R.current_refs(repo.refs).select("oid").join(repo.objects, "oid", "left_semi").collect()})
    shallow = [r["oid"] for r in repo.shallow.orderBy("oid").collect()]
    ask = lambda haves, done: protocol.parse_fetch(transport(UPLOAD, protocol.write_command("fetch", protocol.fetch_arguments(wants, haves, done, shallow, features=features))))
    answer, common = None, []
    for haves in protocol.have_rounds(tips):
        answer = ask(haves, False)
        common += answer["acknowledged"]
        if answer["ready"]:
            break
    if answer is None or not answer["ready"]:
        answer = ask(common, True)
    out = repo.add_table(unpacked(repo, answer["pack"])) if answer["pack"] else repo
    kept = R.shallow_update(repo.shallow, _ids(repo, answer["shallow"]), _ids(repo, answer["unshallow"]))
    return replace(out, shallow=kept).settled()


def push(repo: Repository, transport: Transport, specs: list[str] | None = None, force: bool | None = None) -> DataFrame:
    """Push over a transport: commands with the server's status. PushError for what the server can't do, TransactionError for what
    is no fast-forward."""
    listed = protocol.parse_advertisement(transport(RECEIVE, b""))
    remote = repo.spark.createDataFrame([(r["name"], r["oid"]) for r in listed.refs], "name string, oid string")
    parsed = [RefSpec.parse(s) for s in specs] if specs else [pushing.default_spec(repo.refs)]
    items = Scratch(repo.spark).keep(pushing.plan_refs(R.current_refs(repo.refs), remote, parsed, force))
    pushing.validate_capabilities(items, list(listed.capabilities))
    bad = pushing.check_fast_forward(items, repo.objects, repo.commit_edges(), repo.tags().select("oid", "object")).where("reason IS NOT NULL").first()
    if bad:
        raise TransactionError(f"{bad['remote_ref']}: {bad['reason']}")
    sent = Scratch(repo.spark).keep(pushing.commands(items).where("old_oid <> new_oid"))
    orders = [(r["old_oid"], r["new_oid"], r["ref"]) for r in sent.orderBy("ref").collect()]
    if not orders:
        return sent.select("*").withColumns({"ok": F.lit(True), "message": F.lit(None).cast("string")})
    known = remote.select("oid").join(repo.objects.select("oid"), "oid", "left_semi")
    pack = pack_bytes(repo, pushing.objects_to_send(repo.edges(), items, known, repo.shallow)) if any(new != ZERO_OID for _, new, _ in orders) else b""
    shared = pushing.shared_capabilities(["report-status", "delete-refs", "ofs-delta"], list(listed.capabilities))
    status, rows = protocol.parse_report(transport(RECEIVE, protocol.write_push(orders, pack, shared)))
    if status != "ok":
        raise PushError(f"the server couldn't unpack: {status}")
    return pushing.report(sent, repo.spark.createDataFrame(rows, "ref string, ok boolean, message string"))
