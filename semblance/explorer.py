"""The page that shows pairs of alike functions: a list to filter, and the two texts of a pair line by line."""

PAGE = """<!doctype html>
<html lang="en">
<meta charset="utf-8">
<title>semblance</title>
<style>
  body { font: 14px system-ui, sans-serif; margin: 1rem }
  form { display: flex; gap: .6rem; flex-wrap: wrap; margin-bottom: .8rem }
  input { width: 11rem } input[type=number] { width: 5rem }
  main { display: grid; grid-template-columns: minmax(18rem, 1fr) 2fr; gap: 1rem }
  li { cursor: pointer; padding: .15rem 0 } li:hover, li.on { background: #eef }
  table { border-collapse: collapse; font: 12px ui-monospace, monospace; width: 100% }
  td { white-space: pre-wrap; vertical-align: top; width: 50%; padding: 0 .4rem }
  .gone { background: #fde8e8 } .came { background: #e6f6e6 } .note { color: #777 }
</style>
<h1>Alike functions <small class="note" id="count"></small></h1>
<form>
  <label>score from <input type="number" id="least" min="0" max="1" step="0.05" value="0.5"></label>
  <label>by <select id="metric"><option value="j">Jaccard</option><option value="c">containment</option></select></label>
  <label>name <input id="name"></label>
  <label>path <input id="path"></label>
  <label>lines from <input type="number" id="lines" min="0" value="0"></label>
  <label><input type="checkbox" id="cross" style="width: auto"> other file only</label>
</form>
<main><ol id="pairs"></ol><div id="pair" class="note">Choose a pair.</div></main>
<script>
const at = id => document.getElementById(id);
let pairs = [], cut = false;

function passes(p) {
  const has = (x, needle) => x.toLowerCase().includes(needle.toLowerCase());
  const long = x => x.end - x.line + 1;
  return p[at("metric").value] >= Number(at("least").value)
    && (has(p.a.name, at("name").value) || has(p.b.name, at("name").value))
    && has(p.a.file, at("path").value) && has(p.b.file, at("path").value)
    && Math.min(long(p.a), long(p.b)) >= Number(at("lines").value)
    && (!at("cross").checked || p.a.file !== p.b.file);
}

function list() {
  const chosen = pairs.filter(passes);
  at("count").textContent = chosen.length + " of " + pairs.length + (cut ? " (more are cut off)" : "");
  at("pairs").replaceChildren(...chosen.map(p => {
    const li = document.createElement("li");
    li.textContent = p.j.toFixed(2) + " / " + p.c.toFixed(2) + "  " + p.a.name + " (" + p.a.file + ":" + p.a.line + ") and " + p.b.name + " (" + p.b.file + ":" + p.b.line + ")";
    li.onclick = () => { document.querySelectorAll("li.on").forEach(x => x.classList.remove("on")); li.classList.add("on"); show(p); };
    return li;
  }));
}

// rows [left, right] of two lists of lines; lines of a longest common subsequence stand side by side
function aligned(a, b) {
  const key = x => x.trim();
  const best = Array.from({ length: a.length + 1 }, () => new Uint32Array(b.length + 1));
  for (let i = a.length - 1; i >= 0; i--)
    for (let k = b.length - 1; k >= 0; k--)
      best[i][k] = key(a[i]) === key(b[k]) ? best[i + 1][k + 1] + 1 : Math.max(best[i + 1][k], best[i][k + 1]);
  const rows = [];
  let i = 0, k = 0;
  while (i < a.length || k < b.length) {
    if (i < a.length && k < b.length && key(a[i]) === key(b[k])) rows.push([a[i++], b[k++]]);
    else if (k >= b.length || (i < a.length && best[i + 1][k] >= best[i][k + 1])) rows.push([a[i++], null]);
    else rows.push([null, b[k++]]);
  }
  return rows;
}

async function text(x) {
  const q = new URLSearchParams({ file: x.file, start: x.line, end: x.end });
  const got = await fetch("/api/fn?" + q);
  return got.ok ? (await got.json()).text.split("\\n") : ["(not readable)"];
}

async function show(p) {
  const [a, b] = await Promise.all([text(p.a), text(p.b)]);
  const table = document.createElement("table");
  for (const [left, right] of aligned(a, b)) {
    const tr = table.insertRow();
    const cell = (x, other, mark) => { const td = tr.insertCell(); td.textContent = x ?? ""; if (x !== null && other === null) td.className = mark; };
    cell(left, right, "gone");
    cell(right, left, "came");
  }
  at("pair").replaceChildren(table);
}

document.querySelector("form").oninput = list;
document.querySelector("form").onsubmit = e => e.preventDefault();
fetch("/api/pairs").then(async r => {
  if (!r.ok) { at("count").textContent = "the index is not ready"; return; }
  const got = await r.json();
  pairs = got.pairs;
  cut = got.truncated;
  list();
});
</script>
"""
