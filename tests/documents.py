"""Documents of the shapes the flows have to deal with: crew lists of a shipping line."""

# one wrapper around a table and a card list; row, cell and item tags are never closed
LISTING = """<html><title>Crew list</title><body bgcolor=white>
<p>Season of the long nights
<article id=crew-positions>
<table summary="deck">
<tr><td class="position-deck"><h3><a href='/deck/jobs/cook?berth=2'>Ship's cook</a></h3>
Galley of eight, fresh bread daily. <i>Bergen</i>
<tr><td class="position-deck"><h3><a href='/deck/jobs/bosun'>Bosun</a></h3> Ropes and paint. <i>Narvik</i>
</table>
<ul><li class="position-late"><h4><a href="/deck/jobs/watch">Night watch</a></h4>Two weeks on, two off
<li class="position-late"><h4><a href="/deck/jobs/purser">Purser</a></h4>Keeps the books <b>Hull</b></ul>
</article></body></html>"""

# definition list inside nested tables, links in page chrome on both sides
CUSTOM = """<body><nav><ul><li><a href="/fleet">Fleet</a><li><a href="/ports">Ports</a></ul></nav>
<table><tr><td><table><tr><td>
<dl id="rota">
 <dt class="berth"><strong>Stoker</strong> <a href="/berths/stoker-9">apply</a> <q class="terms">Hot work, Leith</q></dt>
 <dt class="berth odd"><strong>Diver</strong> <a href="/berths/diver-4">apply</a> <q class="terms">Cold work, Oban</q></dt>
 <dt class="berth"><strong>Harbour Pilot</strong> <a href="/berths/pilot-1">apply</a> <q class="terms">Mull, summers</q></dt>
</dl>
</table></td></tr></table>
<footer><dl><dt class="berth"><strong>Office hours</strong> <a href="/berths/office">see</a></dt></dl></footer></body>"""

# nested openings with absolute links, a heading only in one of them
FRAME = """<body><form><main id="lots">
<div class="opening first"><b><a href="https://lots.example.net/line/fleet/7/sailmaker">Master Sailmaker</a></b>
 <div>Loft in Cork, a role ashore</div></div>
<div><div class="opening"><a href="https://lots.example.net/line/fleet/8/rigger"><h5>Junior Rigger</h5></a>
 <div>Afloat</div></div></div>
</main></form></body>"""

# page numbers as a list; the accepted element is the last arrow, after one that leads back
PAGED = """<body><ol class="positions"><li><a href="/crew/1">Able seaman</a></ol>
<footer><ul class="pagination"><li><a href="?from=0">back</a><li>2<li><a class="next" href="?from=40"> Next leg </a></ul>
<link rel="next" href="?from=99"></footer></body>"""
