"""Both ends of an exchange over messages in this process."""

import pytest

from grovespark.catalog import Repository
from grovespark.errors import ProtocolError, PushError, TransactionError
from grovespark.functions import codecs
from grovespark.plans import protocol, services
from grovespark.schema import ZERO_OID

WHO = {"name": "A", "email": "a@x", "timestamp": 1000, "timezone": "+0000"}


def grown(repo, text, ref="refs/heads/main", **more):
    """repo with one more commit of one file on a branch."""
    repo, blob = repo.write_blob(text.encode())
    repo, tree = repo.create_tree([("100644", "f", blob)])
    tip = repo.read_ref(ref)
    repo, commit = repo.create_commit(tree, [tip] if tip else [], WHO | more, text)
    return repo.update_refs({ref: commit}).settled(), commit


def test_fetch_and_push_over_messages(spark):
    theirs, first = grown(Repository.create(spark), "one")
    mine = services.fetch_objects(Repository.create(spark), services.transport_of(services.UploadPackService(theirs)), [first]).update_refs({"refs/heads/main": first})
    theirs, second = grown(theirs, "two", timestamp=2000)
    asked = []
    upload = services.transport_of(services.UploadPackService(theirs))

    def spy(service, request):
        answer = upload(service, request)
        if request:
            asked.append((request, answer))
        return answer

    mine = services.fetch_objects(mine, spy, [second])
    packed = protocol.parse_fetch(asked[-1][1])
    assert packed["ready"] and packed["acknowledged"] == [first] and int.from_bytes(packed["pack"][8:12], "big") == 3, "a commit, its tree and its blob"
    assert mine.cat(second)[0] == "commit" and mine.objects.count() == theirs.objects.count()

    mine = mine.update_refs({"refs/heads/main": second}).settled()
    receive = services.ReceivePackService(Repository.create(spark))
    carry = services.transport_of(receive=receive)
    assert [(r["ref"], r["ok"]) for r in services.push(mine, carry).collect()] == [("refs/heads/main", True)]
    assert receive.repo.read_ref("refs/heads/main") == second and receive.repo.objects.count() == 6
    assert services.push(mine, carry).count() == 0, "nothing to send"
    other, _ = grown(Repository.create(spark), "other")
    with pytest.raises(TransactionError):
        services.push(other, carry, ["refs/heads/main:refs/heads/main"])
    gone = services.push(mine, carry, [":refs/heads/main"]).collect()
    assert gone[0]["ok"] and receive.repo.read_ref("refs/heads/main") is None


def test_what_services_refuse(spark):
    repo, tip = grown(Repository.create(spark), "one")
    upload, receive = services.UploadPackService(repo), services.ReceivePackService(repo)
    carry = services.transport_of(upload, receive)
    for request in (protocol.write_command("what", []), protocol.write_command("fetch", protocol.fetch_arguments(["f" * 40], done=True)), protocol.write_command("fetch", protocol.fetch_arguments([], done=True))):
        with pytest.raises(ProtocolError):
            carry(services.UPLOAD, request)
    with pytest.raises(ProtocolError):
        services.transport_of()(services.UPLOAD, b"")
    alone = protocol.parse_fetch(carry(services.UPLOAD, protocol.write_command("fetch", protocol.fetch_arguments([tip], ["e" * 40]))))
    assert not alone["ready"] and not alone["pack"] and not alone["acknowledged"], "nothing in common: the client goes on"
    status, rows = protocol.parse_report(carry(services.RECEIVE, protocol.write_push([(ZERO_OID, tip, "refs/heads/x")], b"PACK damaged", [])))
    assert status != "ok" and not rows[0][1]
    both = [(ZERO_OID, tip, "refs/heads/x"), ("b" * 40, tip, "refs/heads/main")]
    pack = services.pack_bytes(repo, repo.objects)
    assert [r[1] for r in protocol.parse_report(carry(services.RECEIVE, protocol.write_push(both, pack, ["atomic"])))[1]] == [False, False] and receive.repo.read_ref("refs/heads/x") is None
    assert [r[1] for r in protocol.parse_report(carry(services.RECEIVE, protocol.write_push(both, pack, [])))[1]] == [True, False] and receive.repo.read_ref("refs/heads/x") == tip
    receive.CAPABILITIES = ("report-status",)
    with pytest.raises(PushError):
        services.push(repo, carry, [":refs/heads/x"])
    assert services.remote_sizes(carry, [tip, "f" * 40]) == {tip: len(repo.cat(tip)[1]), "f" * 40: None}
    assert codecs.split_frames(upload.advertise())[0][0][1] == b"version 2\n"
