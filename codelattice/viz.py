"""The graph as one page that needs nothing else: modules as wedges, symbols as points in them, calls as lines."""

from __future__ import annotations

import base64
import html
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import module_of, short_label
from .operators import graph as G
from .operators import risk
from .schema import CALLS, asserted
from .store import Store

# How many symbols a page shows, and up to how many points and for how many sweeps a module is relaxed.
MAX_NODES, MAX_RELAXED, SWEEPS = 20_000, 4_000, 70
LANDMARKS = 44


def relax(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, low: float, high: float, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Points pushed apart and pulled along their pairs, kept between two angles and inside the circle. Same input, same output."""
    n = len(x)
    if n < 3 or n > MAX_RELAXED:
        return x, y
    ideal = 0.6 * math.sqrt((high - low) / 2 / n)
    for sweep in range(sweeps):
        heat = ideal * (1 - sweep / sweeps)
        fx, fy = np.zeros(n), np.zeros(n)
        for k in range(0, n, 512):
            dx, dy = x[k : k + 512, None] - x[None, :], y[k : k + 512, None] - y[None, :]
            push = ideal * ideal / (dx * dx + dy * dy + 1e-6)
            fx[k : k + 512], fy[k : k + 512] = (dx * push).sum(1), (dy * push).sum(1)
        if len(pairs):
            a, b = pairs[:, 0], pairs[:, 1]
            dx, dy = x[b] - x[a], y[b] - y[a]
            pull = np.sqrt(dx * dx + dy * dy) / ideal
            for sign, at in ((1, a), (-1, b)):
                fx += np.bincount(at, sign * dx * pull, n)
                fy += np.bincount(at, sign * dy * pull, n)
        size = np.sqrt(fx * fx + fy * fy) + 1e-9
        x, y = x + fx / size * np.minimum(size, heat), y + fy / size * np.minimum(size, heat)
        r, angle = np.clip(np.hypot(x, y), 0.15, 1.0), np.mod(np.arctan2(y, x) - low, 2 * math.pi)
        angle = low + np.where(angle > high - low, np.where(angle < math.pi + (high - low) / 2, high - low, 0), angle)
        x, y = r * np.cos(angle), r * np.sin(angle)
    return x, y


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, module, x, y: modules get angles by their sizes, and each is laid out by itself in the order from its hub."""
    members = nodes.select(F.col("qualified_name").alias("node"), module_of(F.col("file")).alias("module"))
    sizes = [(r["module"], r["count"]) for r in members.groupBy("module").count().orderBy("module").collect()]  # top directories
    total, angles, at = sum(n for _, n in sizes) or 1, {}, 0.0
    for module, n in sizes:
        angles[module] = (at, at + 2 * math.pi * n / total)
        at = angles[module][1]
    order = G.hub_order(edges, members)
    calls = asserted(edges, CALLS).select("source", "target").distinct()
    inner = calls.join(members.select(F.col("node").alias("source"), "module"), "source").join(members.select(F.col("node").alias("target"), F.col("module").alias("m2")), "target").where("module = m2").select("source", "target", F.col("m2").alias("part"))

    def place(key: tuple, points: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        low, high = angles[key[0]]
        points = points.sort_values("place").reset_index(drop=True)
        k, n = np.arange(len(points)), len(points)
        r, a = 0.2 + 0.75 * np.sqrt((k + 0.5) / max(1, n)), low + (high - low) * np.mod(k * 0.6180339887, 1)
        index = {name: i for i, name in enumerate(points["node"])}
        at = np.array([(index[s], index[t]) for s, t in zip(pairs["source"], pairs["target"]) if s != t], np.int64).reshape(-1, 2)
        x, y = relax(r * np.cos(a), r * np.sin(a), at, low, high)
        return pd.DataFrame({"node": points["node"], "module": key[0], "x": x, "y": y})

    return order.groupBy("module").cogroup(inner.groupBy("part")).applyInPandas(place, "node string, module string, x double, y double")


def packed(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values).tobytes()).decode()


def page(store: Store, max_nodes: int = MAX_NODES, mode: str = "community") -> Iterator[str]:
    """The page, in pieces. Of a larger graph the first max_nodes symbols by name are shown, and the page says so."""
    every = store.table("nodes")
    total = every.count()
    nodes = every.orderBy("qualified_name").limit(max_nodes)
    edges = store.table("edges").join(nodes.select(F.col("qualified_name").alias("source")), "source", "left_semi").join(nodes.select(F.col("qualified_name").alias("target")), "target", "left_semi")
    placed = layout(nodes, edges).withColumnRenamed("node", "qualified_name")
    scores = risk.scored(nodes, edges).select("qualified_name", "score", "fan_in", "kind", "language", short_label(F.col("qualified_name")).alias("label"))
    rows = placed.join(scores, "qualified_name").orderBy("qualified_name").toPandas()  # at most max_nodes rows
    index = {n: i for i, n in enumerate(rows["qualified_name"])}
    lines = asserted(edges).select("source", "target", "kind").distinct().orderBy("source", "target", "kind").toPandas()
    ends = np.array([(index[s], index[t]) for s, t in zip(lines["source"], lines["target"])], np.uint32).reshape(-1, 2)
    chords = [r.asDict() for r in G.module_chords(nodes, edges).orderBy("a", "b").collect()]
    data = {
        "mode": "full" if mode == "full" else "community", "truncated": total > len(rows), "total": total, "names": rows["qualified_name"].tolist(), "labels": rows["label"].tolist(), "modules": rows["module"].tolist(),
        "languages": rows["language"].tolist(), "points": packed(rows[["x", "y"]].to_numpy(np.float32)), "risk": packed(np.clip(rows["score"].to_numpy() * 255, 0, 255).astype(np.uint8)),
        "callers": packed(np.minimum(rows["fan_in"].to_numpy(), 65535).astype(np.uint16)), "edges": packed(ends), "tests": packed((lines["kind"] != CALLS).to_numpy(np.uint8)), "chords": chords,
        "landmarks": rows.sort_values(["fan_in", "qualified_name"], ascending=[False, True], kind="stable").index[:LANDMARKS].tolist(),
    }
    yield "<!doctype html><meta charset=utf-8><title>codelattice</title>" + STYLE + "<div id=bar><input id=find placeholder=name><span id=note></span></div><canvas id=c></canvas><script>const D="
    yield json.dumps(data, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")
    yield ";" + SCRIPT + "</script>" + f"<!-- {html.escape(str(total))} symbols -->\n"


STYLE = "<style>html,body{margin:0;height:100%;background:#111;color:#ddd;font:13px sans-serif}canvas{display:block}#bar{position:fixed;top:8px;left:8px}#note{margin-left:8px}</style>"
SCRIPT = """
const bytes=s=>Uint8Array.from(atob(s),c=>c.charCodeAt(0)).buffer,P=new Float32Array(bytes(D.points)),E=new Uint32Array(bytes(D.edges)),R=new Uint8Array(bytes(D.risk)),T=new Uint8Array(bytes(D.tests));
const c=document.getElementById('c'),g=c.getContext('2d'),n=D.names.length,back=Array.from({length:n},()=>[]);
for(let i=0;i<E.length;i+=2)back[E[i+1]].push(E[i]);
let hit=-1,level=new Map();
const at=i=>[c.width/2+P[2*i]*c.height*.46,c.height/2+P[2*i+1]*c.height*.46];
function cascade(i){level=new Map([[i,0]]);let now=[i];for(let h=1;h<4;h++){const next=[];for(const a of now)for(const b of back[a])if(!level.has(b)){level.set(b,h);next.push(b)}now=next}}
function draw(){c.width=innerWidth;c.height=innerHeight;g.lineWidth=.3;g.strokeStyle='#456';g.beginPath();for(let i=0;i<E.length;i+=2){if(T[i/2])continue;g.moveTo(...at(E[i]));g.lineTo(...at(E[i+1]))}g.stroke();
for(let i=0;i<n;i++){const[x,y]=at(i),l=level.get(i);g.fillStyle=l===undefined?`hsl(${120-R[i]/255*120},60%,${level.size?25:55}%)`:['#fff','#f66','#fa6','#fd8'][l];g.fillRect(x-1.5,y-1.5,3,3)}
g.fillStyle='#ccc';for(const i of hit<0?D.landmarks:[hit])g.fillText(D.labels[i],...at(i))
document.getElementById('note').textContent=hit<0?`${n} of ${D.total} symbols`:`${D.names[hit]}: ${level.size-1} in reach`}
c.onclick=e=>{let best=1e9;hit=-1;for(let i=0;i<n;i++){const[x,y]=at(i),d=(x-e.clientX)**2+(y-e.clientY)**2;if(d<best&&d<100){best=d;hit=i}}level=new Map();if(hit>=0)cascade(hit);draw()};
document.getElementById('find').oninput=e=>{const q=e.target.value.toLowerCase();hit=q?D.names.findIndex(x=>x.toLowerCase().includes(q)):-1;level=new Map();if(hit>=0)cascade(hit);draw()};
onresize=draw;draw()
"""
