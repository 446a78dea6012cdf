"""Catalogue of aggregations (A), tensors (X), losses (L), sampling (O) and mesh operators (R)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from voxloom.functions import strings, tensors
from voxloom.operators import descent, layers, mesh, metrics, remesh, sampling, spatial, volume
from voxloom.plans import fixtures as x
from voxloom.plans.fixtures import R, Catalog, r6, rounded
from voxloom.plans.scratch import writer

catalog = Catalog()
op, add = catalog.op, catalog.add
H, W, D = x.GRID

EXTENTS = {f"{f}_{c}": f"{f}({c})" for c in "xyz" for f in ("min", "max")}
add("A1_extents", lambda s, d: spatial.grid_extent(x.points(s, d)).select("cloud_id", *[r6(F.col(n)).alias(n) for n in EXTENTS]), f"SELECT cloud_id, {R(**EXTENTS)} FROM {x.POINTS} GROUP BY 1")
add("A2_counts", lambda s, d: x.points(s, d).groupBy("cloud_id").agg(F.count("*").alias("n")), f"SELECT cloud_id, count(*) AS n FROM {x.POINTS} GROUP BY 1")
add("A3_occupancy_sum", lambda s, d: volume.occupied_cells(x.volume(s, d)), f"SELECT sample_id, count(*) AS occupied FROM {x.VOLUME} WHERE value > 0 GROUP BY 1")


@op("A4_dataset_statistics", f"SELECT (SELECT count(DISTINCT sample_id) FROM {x.VOLUME}) AS samples, {R(per_sample=f'(SELECT avg(n) FROM (SELECT count(*) FILTER (WHERE value > 0) AS n FROM {x.VOLUME} GROUP BY sample_id))', points=f'(SELECT avg(n) FROM (SELECT count(*) AS n FROM {x.POINTS} GROUP BY cloud_id))')}, (SELECT count(*) FROM (SELECT DISTINCT h, w, d FROM {x.VOLUME} WHERE value > 6)) AS union_mask")
def dataset_statistics(spark, sf):
    v = x.volume(spark, sf)
    per_sample = v.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("n")).agg(F.count("*").alias("samples"), r6(F.avg("n")).alias("per_sample"))
    clouds = x.points(spark, sf).groupBy("cloud_id").count().agg(r6(F.avg("count")).alias("points"))
    mask = v.where("value > 6").select("h", "w", "d").distinct().agg(F.count("*").alias("union_mask"))
    return per_sample.crossJoin(F.broadcast(clouds)).crossJoin(F.broadcast(mask))  # one row each


add("A5_frames_per_track", lambda s, d: x.frames(s, d).groupBy("track").agg((F.count("*") + 1).alias("frames")), f"SELECT track, count(*)+1 AS frames FROM {x.FRAMES} GROUP BY 1")
THRESHOLDED = "CASE WHEN pred > 0.5 THEN 1.0 WHEN pred < 0.5 THEN 0.0 ELSE pred END"
add("A6_completion_metrics", lambda s, d: metrics.completion(x.predictions(s, d)).select(*[r6(F.col(c)).alias(c) for c in ("occ_l1", "occ_hamming", "sdf_l1", "sdf_hamming")], "voxels"),
    f"SELECT {R(occ_l1='avg(abs(pred-target))', occ_hamming=f'avg(abs({THRESHOLDED}-target))', sdf_l1='avg(abs(pred_sdf-target_sdf))', sdf_hamming='avg(abs(CASE WHEN pred_sdf < 0 THEN 1.0 ELSE 0.0 END-target))')}, count(*) AS voxels FROM {x.PREDICTIONS}")


@op("A7_distance_field", f"SELECT cloud_id, h, {R(nearest='min(m)', farthest='max(m)')} FROM (SELECT cloud_id, h, w, d, sqrt(min((w+0.5-x)*(w+0.5-x)+(h+0.5-y)*(h+0.5-y)+(d+0.5-z)*(d+0.5-z))) AS m FROM {x.POINTS} p, (SELECT k//({W}*{D}) AS h, (k//{D})%{W} AS w, k%{D} AS d FROM (SELECT unnest(range({H * W * D})) AS k)) GROUP BY ALL) GROUP BY 1, 2")
def distance_field(spark, sf):
    field = spatial.distance_field(x.points(spark, sf), x.GRID)
    return field.groupBy("cloud_id", F.col("h").cast("long").alias("h")).agg(r6(F.min("distance")).alias("nearest"), r6(F.max("distance")).alias("farthest"))


def cross_sql(n: str) -> str:
    i, j = {"x": "yz", "y": "zx", "z": "xy"}[n]
    return f"(k{i}-a{i})*(c{j}-a{j})-(k{j}-a{j})*(c{i}-a{i})"


AREA = f"sqrt(pow({cross_sql('x')},2)+pow({cross_sql('y')},2)+pow({cross_sql('z')},2))/2"
add("A10_mesh_area", lambda s, d: mesh.areas(x.triangles(s, d)).groupBy("mesh_id").agg(r6(F.sum("area")).alias("area")), f"SELECT mesh_id, {R(area=f'sum({AREA})')} FROM {x.TRIANGLES} GROUP BY 1")
add("A11_centroids", lambda s, d: x.points(s, d).groupBy("cloud_id").agg(*[r6(F.avg(c)).alias(f"mean_{c}") for c in "xyz"], *[r6((F.min(c) + F.max(c)) / 2).alias(f"mid_{c}") for c in "xyz"]),
    f"SELECT cloud_id, {R(**{f'mean_{c}': f'avg({c})' for c in 'xyz'}, **{f'mid_{c}': f'(min({c})+max({c}))/2' for c in 'xyz'})} FROM {x.POINTS} GROUP BY 1")
add("A12_median", lambda s, d: x.points(s, d).groupBy("cloud_id").agg(r6(F.median("x")).alias("median")), f"SELECT cloud_id, {R(median='median(x)')} FROM {x.POINTS} GROUP BY 1")
EDGE = lambda p, q: "sqrt(" + "+".join(f"pow({q}{n}-{p}{n},2)" for n in "xyz") + ")"
add("A13_mean_edge", lambda s, d: mesh.edge_lengths(x.triangles(s, d)).select("mesh_id", r6(F.col("mean") * 0.8).alias("mean")), f"SELECT mesh_id, {R(mean=f'avg(({EDGE("a", "k")}+{EDGE("k", "c")}+{EDGE("c", "a")})/3)*0.8')} FROM {x.TRIANGLES} GROUP BY 1")


def grid_mesh(spark, sf):
    """Closed-form meshes: of each 256 vectors a 16 x 16 sheet whose heights come from them; vertices and faces. The last sheet ends where the vectors do."""
    at = F.col("vec_id") % 256
    v = x.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("mesh_id"), F.col("vec_id").alias("vid"), (at % 16).cast("double").alias("x"), F.floor(at / 16).cast("double").alias("y"), (x.e(1) * 4).alias("z"))
    quads = v.where("x < 15 AND y < 15").select("mesh_id", "vid").join(v.select((F.col("vid") - 17).alias("vid")), "vid", "left_semi")
    two = F.explode(F.array(F.struct((F.col("vid") * 2).alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 16).alias("v2")), F.struct((F.col("vid") * 2 + 1).alias("fid"), (F.col("vid") + 1).alias("v0"), (F.col("vid") + 17).alias("v1"), (F.col("vid") + 16).alias("v2"))))
    return v, quads.select("mesh_id", two.alias("f")).select("mesh_id", "f.*")


SHEET_V = f"(SELECT vec_id // 256 AS mesh_id, vec_id AS vid, CAST(vec_id % 16 AS DOUBLE) AS x, CAST((vec_id % 256) // 16 AS DOUBLE) AS y, {x.E(1)}*4 AS z FROM embeddings)"
QUADS = "x < 15 AND y < 15 AND vid+17 IN (SELECT vec_id FROM embeddings)"
SHEET_F = f"(SELECT mesh_id, vid*2 AS fid, vid AS v0, vid+1 AS v1, vid+16 AS v2 FROM {SHEET_V} WHERE {QUADS} UNION ALL SELECT mesh_id, vid*2+1, vid+1, vid+17, vid+16 FROM {SHEET_V} WHERE {QUADS})"
SHEET_E = f"(SELECT mesh_id, fid, least(p,q) AS u, greatest(p,q) AS v, o FROM (SELECT mesh_id, fid, v0 AS p, v1 AS q, v2 AS o FROM {SHEET_F} UNION ALL SELECT mesh_id, fid, v1, v2, v0 FROM {SHEET_F} UNION ALL SELECT mesh_id, fid, v2, v0, v1 FROM {SHEET_F}))"


@op("A14_hull_energy", f"SELECT mesh_id, {R(energy='near+stretch')} FROM (SELECT mesh_id, 0.5*sum(z*z) AS near FROM {SHEET_V} GROUP BY 1) JOIN (SELECT e.mesh_id, sum(pow(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)-1.44,2)) AS stretch FROM (SELECT DISTINCT mesh_id, u, v FROM {SHEET_E}) e JOIN {SHEET_V} a ON a.vid = e.u JOIN {SHEET_V} b ON b.vid = e.v GROUP BY 1) USING (mesh_id)")
def hull_energy(spark, sf):
    v, f = grid_mesh(spark, sf)
    targets = v.select("mesh_id", "vid", F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(0.0).alias("tz"))
    return mesh.hull_energy(f, v, targets, 0.5, 1.2).select("mesh_id", r6(F.col("energy")).alias("energy"))


PAIRS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
add("A15_covariance", lambda s, d: x.points(s, d).groupBy("cloud_id").agg(*[r6(F.covar_pop(a, b)).alias(f"c_{a}{b}") for a, b in PAIRS]), f"SELECT cloud_id, {R(**{f'c_{a}{b}': f'covar_pop({a},{b})' for a, b in PAIRS})} FROM {x.POINTS} GROUP BY 1")


@op("P17_cloud_normals")
def cloud_normals(spark, sf):
    """Normals of neighbourhoods; tests check them on planes."""
    return spatial.neighbour_normals(x.points(spark, sf), 6.0).select("query_id", *rounded(nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")))


add("A17_code_statistics", lambda s, d: x.codes(s, d).groupBy("dim").agg(r6(F.avg("mu")).alias("mean"), r6(F.stddev_samp("mu")).alias("std")), f"SELECT dim, {R(mean='avg(mu)', std='stddev_samp(mu)')} FROM {x.CODES} GROUP BY 1")
add("A18_batch_average", lambda s, d: x.protocol(s, d).groupBy(F.floor((F.col("iter") - 1) / 16).alias("batch")).agg(F.avg("loss").alias("m"), F.count("*").alias("n")).agg(r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean")), f"SELECT {R(mean='avg(loss)')} FROM {x.PROTOCOL}")
add("A19_element_products", lambda s, d: x.table(s, d, "embeddings").select("vec_id", r6(F.aggregate(F.slice("embedding", 1, 4), F.lit(1.0), lambda a, v: a * v.cast("double"))).alias("product"), r6(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total")),
    f"SELECT vec_id, {R(product='*'.join(x.E(k) for k in range(1, 5)), total='list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)))')} FROM embeddings")
add("A20_area_shares", lambda s, d: mesh.area_shares(x.triangles(s, d)).select("mesh_id", "fid", r6(F.col("share")).alias("share")), f"SELECT mesh_id, fid, {R(share=f'sum({AREA}) OVER (PARTITION BY mesh_id ORDER BY fid ROWS UNBOUNDED PRECEDING)/sum({AREA}) OVER (PARTITION BY mesh_id)')} FROM {x.TRIANGLES}")
add("A21_density_totals", lambda s, d: mesh.areas(x.triangles(s, d)).withColumn("density", F.col("fid") % 3 + 1).groupBy("mesh_id").agg(r6(F.sum(F.col("area") * F.col("density"))).alias("total")), f"SELECT mesh_id, {R(total=f'sum({AREA}*(fid%3+1))')} FROM {x.TRIANGLES} GROUP BY 1")

# Tensors.
VOL = lambda name, make, sql: add(name, lambda s, d: x.volume(s, d).select("sample_id", "h", "w", "d", r6(make()).alias("value")), f"SELECT sample_id, h, w, d, {R(value=sql)} FROM {x.VOLUME}")
VOL("X1_truncate", lambda: tensors.truncate(F.col("value")), "greatest(-5, least(5, value))")
VOL("X2_signed_log", lambda: tensors.signed_log(tensors.truncate(F.col("value"))), "sign(value)*ln(1+abs(greatest(-5, least(5, value))))")
VOL("X8_channel_nonlinearity", lambda: F.when(F.col("d") % 2 == 0, tensors.sigmoid(F.col("value"))).otherwise(F.col("value")), "CASE WHEN d % 2 = 0 THEN 1/(1+exp(-value)) ELSE value END")
VOL("X10_reparameterise", lambda: tensors.reparameterised(F.col("value"), F.lit(-1.0), tensors.uniform_of(F.col("sample_id").cast("string"))), "exp(-0.5)*(CAST('0x'||substr(md5(CAST(sample_id AS VARCHAR)),1,8) AS BIGINT)/4294967296.0)+value")
ERF = "(sign({z})*(1-(((((1.061405429*({t})-1.453152027)*({t})+1.421413741)*({t})-0.284496736)*({t})+0.254829592)*({t}))*exp(-({z})*({z}))))"
Z = f"({math.exp(1.0) * 0.707106781!r}*(0.5-value))"
VOL("X9_gaussian_bernoulli", lambda: tensors.gaussian_to_bernoulli(F.col("value")), "0.5*(1+" + ERF.format(z=Z, t=f"1/(1+0.3275911*abs({Z}))") + ")")
add("X3_occupancy_from_distance", lambda s, d: x.volume(s, d).groupBy("sample_id").agg(F.sum(tensors.occupied(F.col("value"))).alias("occupied")), f"SELECT sample_id, count(*) FILTER (WHERE value <= 0) AS occupied FROM {x.VOLUME} GROUP BY 1")
add("X4_threshold", lambda s, d: x.predictions(s, d).select("sample_id", "h", "w", "d", tensors.thresholded(F.col("pred")).alias("value")), f"SELECT sample_id, h, w, d, CAST({THRESHOLDED} AS DOUBLE) AS value FROM {x.PREDICTIONS}")
add("X5_dense_sparse", lambda s, d: volume.sparse(volume.unpack(volume.pack(x.volume(s, d), (4, 4, 4)), 4, 4), 3.0), f"SELECT sample_id, h, w, d FROM {x.VOLUME} WHERE value > 3")
add("X6_transpose", lambda s, d: volume.transposed(x.volume(s, d)).where("h = 1").select("sample_id", "h", "w", "d", r6(F.col("value")).alias("value")), f"SELECT sample_id, w AS h, h AS w, d, {R(value='value')} FROM {x.VOLUME} WHERE w = 1")
add("X7_flat_index", lambda s, d: x.volume(s, d).select("sample_id", tensors.flat_index(F.col("h"), F.col("w"), F.col("d"), 4, 4).cast("int").alias("k"), r6(F.col("value")).alias("value")), f"SELECT vec_id AS sample_id, CAST(k AS INT) AS k, {R(value='CAST(embedding[k+1] AS DOUBLE)*20')} FROM embeddings, (SELECT unnest(range(64)) AS k)")
PATHS = "(SELECT page_id, url FROM pages)"
add("X11_strings", lambda s, d: x.table(s, d, "pages").select("page_id", strings.base_name(F.col("url")).alias("base"), strings.zero_filled(F.col("page_id"), 8).alias("filled"), strings.dotted(F.col("page_id") * 12345).alias("dotted"), strings.normalised(F.concat(F.lit("  a \t"), F.col("url"), F.lit(" \n"))).alias("clean"), strings.chop(F.concat(F.col("url"), F.lit(" \r\n"))).alias("chopped")),
    "SELECT page_id, split_part(url, '/', -1) AS base, lpad(CAST(page_id AS VARCHAR), 8, '0') AS filled, replace(format('{:,}', page_id*12345), ',', '.') AS dotted, 'a ' || url AS clean, url AS chopped FROM pages")
add("X12_reverse", lambda s, d: x.table(s, d, "embeddings").select("vec_id", r6(F.get(F.reverse("embedding"), 0).cast("double")).alias("first")), f"SELECT vec_id, {R(first=x.E(64))} FROM embeddings")
add("X13_file_names", lambda s, d: x.table(s, d, "documents").select("doc_id", strings.file_name(F.col("source"), F.col("lang"), F.col("doc_id") % 10, H, W, D, "txt").alias("name")), f"SELECT doc_id, source || '_' || lang || '_' || (doc_id % 10) || '_{H}x{W}x{D}.txt' AS name FROM documents")

# Losses.
add("L1_gaussian_kl", lambda s, d: metrics.kl(x.codes(s, d)).select("sample_id", r6(F.col("kl")).alias("kl")), f"SELECT sample_id, {R(kl='sum(0.5*(mu*mu+exp(lv)-1-lv))')} FROM {x.CODES} GROUP BY 1")
add("L1_kl_gradients", lambda s, d: x.codes(s, d).select("sample_id", "dim", *rounded(mean=tensors.kl_gradients(F.col("mu"), F.col("lv"))[0], variance=tensors.kl_gradients(F.col("mu"), F.col("lv"))[1])), f"SELECT sample_id, dim, {R(mean='mu', variance='0.5*(exp(lv)-1)')} FROM {x.CODES}")
CHANCE = "(1-0.5*(1+" + ERF.format(z=f"({math.exp(1.0) * 0.707106781!r}*(0.0-pred))", t=f"1/(1+0.3275911*abs({math.exp(1.0) * 0.707106781!r}*(0.0-pred)))") + "))"


def bce_sql(p: str, t: str, w: str = "1") -> str:
    return f"sum(-({w})*(({t})*ln(({p})+1e-12)+(1-({t}))*ln(1-({p})+1e-12)))"


LOSSES = {
    "gaussian_nll": f"sum(0.5*{math.exp(2.0)!r}*(target-pred)*(target-pred))", "bce": bce_sql("pred", "target"), "weighted_bce": bce_sql("pred", "target", "2"), "point_bce": bce_sql("pred", "target", "target"), "free_space_bce": bce_sql("pred", "1-target", "target"),
    "gaussian_bce": bce_sql(CHANCE, "target"), "gaussian_point_bce": bce_sql(CHANCE, "target", "target"), "gaussian_free_space_bce": bce_sql(CHANCE, "1-target", "target"),
}
for number, names in {"L2": ["gaussian_nll"], "L3": ["bce", "weighted_bce"], "L4": ["point_bce"], "L5": ["free_space_bce"], "L7": ["gaussian_bce", "gaussian_point_bce", "gaussian_free_space_bce"]}.items():
    add(f"{number}_{names[0]}", lambda s, d, names=names: metrics.losses(x.predictions(s, d)).select(*[F.round(F.col(n), 3).alias(n) for n in names]), f"SELECT {', '.join(f'round({LOSSES[n]}, 3) AS {n}' for n in names)} FROM {x.PREDICTIONS}")
add("L3_bce_gradient", lambda s, d: x.predictions(s, d).select("sample_id", "h", "w", "d", r6(tensors.bce_gradient(F.col("pred"), F.col("target"))).alias("grad")), f"SELECT sample_id, h, w, d, {R(grad='-(target-pred)/((1-pred+1e-12)*(pred+1e-12))')} FROM {x.PREDICTIONS}")


@op("L6_weighted_free_space", f"WITH p AS (SELECT * FROM {x.PREDICTIONS}), s AS (SELECT h, w, d, avg(target) AS share FROM p GROUP BY 1, 2, 3) SELECT round({bce_sql('pred', '1-target', 'target*share')}, 3) AS loss FROM p JOIN s USING (h, w, d)")
def weighted_free_space(spark, sf):
    p = x.predictions(spark, sf)
    return metrics.weighted_free_space(p, p.groupBy("h", "w", "d").agg(F.avg("target").alias("share"))).select(F.round("loss", 3).alias("loss"))


add("L8_gaussian_prior", lambda s, d: metrics.gaussian_prior(x.codes(s, d)).select(r6(F.col("prior")).alias("prior")), f"SELECT {R(prior='ln(2*pi())*count(DISTINCT sample_id)/2+0.5*sum(mu*mu)')} FROM {x.CODES}")
add("L9_combined_criterion", lambda s, d: metrics.losses(x.predictions(s, d)).select(F.round(0.7 * F.col("bce") + 0.3 * F.col("gaussian_nll"), 3).alias("loss")), f"SELECT round(0.7*{LOSSES['bce']}+0.3*{LOSSES['gaussian_nll']}, 3) AS loss FROM {x.PREDICTIONS}")
add("L10_weight_decay", lambda s, d: metrics.weight_decay(x.codes(s, d), 1e-4).select(F.round("decay", 9).alias("decay")), f"SELECT round(1e-4*sum(mu*mu)/2, 9) AS decay FROM {x.CODES}")
U01 = "(CAST('0x'||substr(md5('init:'||vec_id),1,8) AS BIGINT)/4294967296.0)"
add("L11_initial_weights", lambda s, d: x.table(s, d, "embeddings").select("vec_id", *[r6(tensors.initial_weight(m, 24, 12, tensors.uniform_of(F.lit("init"), F.col("vec_id").cast("string")), F.lit(0.0), 0.05)).alias(m) for m in ("fixed", "uniform", "heuristic", "xavier", "xavier_caffe", "kaiming")]),
    f"SELECT vec_id, {R(fixed='0.05', uniform=f'(2*{U01}-1)*0.05', heuristic=f'(2*{U01}-1)*sqrt(1/24.0)', xavier=f'(2*{U01}-1)*sqrt(6/36.0)', xavier_caffe=f'(2*{U01}-1)*sqrt(3/24.0)', kaiming=f'(2*{U01}-1)*sqrt(12/36.0)')} FROM embeddings")
@op("L12_layer_sizes", f"SELECT box_id, CAST(layer AS INT) AS layer, CAST(floor(sy) AS BIGINT)//p AS h, CAST(floor(sx) AS BIGINT)//p AS w, CAST(floor(sz) AS BIGINT)//p AS d FROM {x.BOXES}, (VALUES (1, 2), (2, 4), (3, 12)) t(layer, p)")
def layer_sizes(spark, sf):
    """The grid that a box of voxels has after each of three layers."""
    axes = {n: tensors.layer_size_columns(F.floor(c), [3, 3, 3], [2, 2, 3]) for n, c in (("h", "sy"), ("w", "sx"), ("d", "sz"))}
    layers = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("layer"), *[axes[n][k].alias(n) for n in "hwd"]) for k in range(3)]))
    return x.boxes(spark, sf).select("box_id", layers.alias("l")).select("box_id", "l.*")


add("L13_max_pool", lambda s, d: volume.pooled(x.volume(s, d), 2).select("sample_id", "h", "w", "d", r6(F.col("value")).alias("value")), f"SELECT sample_id, CAST(h//2 AS INT) AS h, CAST(w//2 AS INT) AS w, CAST(d//2 AS INT) AS d, {R(value='max(value)')} FROM {x.VOLUME} GROUP BY 1, 2, 3, 4")
add("L13_upsample", lambda s, d: volume.upsampled(x.volume(s, d), 2).select("sample_id", "h", "w", "d", r6(F.col("value")).alias("value")), f"SELECT sample_id, CAST(h*2+a AS INT) AS h, CAST(w*2+b AS INT) AS w, CAST(d*2+c AS INT) AS d, {R(value='value')} FROM {x.VOLUME}, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b), (SELECT unnest(range(2)) AS c)")


@op("L14_linear_layer", "WITH m AS (SELECT o, i, (o*7+i*3)%11/10.0-0.5 AS w FROM (SELECT unnest(range(4)) AS o), (SELECT unnest(range(64)) AS i)) SELECT vec_id, CAST(o AS INT) AS o, round(sum(w*CAST(embedding[i+1] AS DOUBLE)),6)+0.0 AS value FROM embeddings, m GROUP BY 1, 2")
def linear_layer(spark, sf):
    """A matrix of fixed size times each vector; the matrix is a literal of the plan."""
    rows = [F.aggregate(F.zip_with(F.transform("embedding", lambda v: v.cast("double")), F.array(*[F.lit((o * 7 + i * 3) % 11 / 10.0 - 0.5) for i in range(64)]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) for o in range(4)]
    return x.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.array(*rows)).alias("o", "value")).select("vec_id", "o", r6(F.col("value")).alias("value"))


def channels(spark, sf):
    """Volumes of two channels: the values and their signs' half."""
    both = F.array(F.col("value"), F.when(F.col("value") > 0, 0.5).otherwise(-0.5))
    return x.volume(spark, sf).select("sample_id", "h", "w", "d", F.posexplode(both).alias("channel", "value"))


CHANNELS = f"(SELECT sample_id, h, w, d, CAST(channel AS INT) AS channel, CASE WHEN channel = 0 THEN value WHEN value > 0 THEN 0.5 ELSE -0.5 END AS value FROM {x.VOLUME}, (SELECT unnest(range(2)) AS channel))"
KERNEL = np.array([[[(o * 7 + i * 5 + k * 3) % 13 / 13.0 - 0.5 for k in range(27)] for i in range(2)] for o in range(3)]).reshape(3, 2, 3, 3, 3)
NEIGHBOURS = f"SELECT p.sample_id, CAST(o AS INT) AS channel, p.h, p.w, p.d, sum(q.value*((o*7+q.channel*5+((q.h-p.h+1)*9+(q.w-p.w+1)*3+q.d-p.d+1)*3)%13/13.0-0.5))+o*0.1 AS value FROM {x.VOLUME} p JOIN {CHANNELS} q ON p.sample_id = q.sample_id AND abs(p.h-q.h) <= 1 AND abs(p.w-q.w) <= 1 AND abs(p.d-q.d) <= 1, (SELECT unnest(range(3)) AS o) GROUP BY p.sample_id, o, p.h, p.w, p.d"
NORMALISED = "SELECT sample_id, channel, h, w, d, (value-avg(value) OVER (PARTITION BY channel))/sqrt(var_pop(value) OVER (PARTITION BY channel)+1e-5)*2+0.5 AS value FROM {of}"
LAYER = ("sample_id", "channel", "h", "w", "d")


def convolved(spark, sf):
    return layers.convolved(channels(spark, sf), KERNEL, [0.0, 0.1, 0.2], (4, 4, 4))


add("L14_convolution", lambda s, d: convolved(s, d).select(*LAYER, r6(F.col("value")).alias("value")), f"SELECT sample_id, channel, h, w, d, {R(value='value')} FROM ({NEIGHBOURS})")


@op("L14_batch_norm", f"SELECT sample_id, channel, h, w, d, {R(value='value')} FROM ({NORMALISED.format(of=CHANNELS)})")
def batch_norm(spark, sf):
    volumes = channels(spark, sf)
    return layers.normalised(volumes, layers.moments(volumes), 2.0, 0.5).select(*LAYER, r6(F.col("value")).alias("value"))


@op("L14_encoder_block", f"SELECT sample_id, channel, CAST(h//2 AS INT) AS h, CAST(w//2 AS INT) AS w, CAST(d//2 AS INT) AS d, {R(value='max(greatest(value, 0))')} FROM ({NORMALISED.format(of=f'({NEIGHBOURS})')}) GROUP BY 1, 2, 3, 4, 5")
def encoder_block(spark, sf):
    """Convolution, normalisation, rectifier and pooling; the convolution is written once for the two that read it."""
    inner = writer(spark)(convolved(spark, sf), "convolved")
    block = layers.pooled(layers.rectified(layers.normalised(inner, layers.moments(inner), 2.0, 0.5)), 2)
    return block.select(*LAYER, r6(F.col("value")).alias("value"))


def coded(spark, sf):
    """(sample_id, z, target): codes of 8 numbers and the occupancy of 64 voxels."""
    numbers = F.transform("embedding", lambda v: v.cast("double") * 20)
    return x.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.slice(numbers, 1, 8).alias("z"), F.transform(numbers, lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("target"))


@op("L16_weight_descent")
def weight_descent(spark, sf):
    """The mean loss before each of 20 steps of momentum descent on shared weights; tests compare with a numpy loop."""
    samples = writer(spark)(coded(spark, sf), "samples")
    _, _, losses = descent.fit_weights(samples, 64, 8, 20, descent.Schedule(), weight_decay=1e-4)
    return spark.createDataFrame([(k, v) for k, v in enumerate(losses)], "step int, loss double").select("step", r6(F.col("loss")).alias("loss"))


@op("G9_code_descent")
def code_descent(spark, sf):
    """Each sample's code under a fixed decoder, from what is seen of it; tests compare with a loop for each sample."""
    seen = coded(spark, sf).withColumn("target", F.transform("target", lambda v, k: F.when(F.pmod(k + F.col("sample_id"), F.lit(3)) != 0, v)))
    weights = np.array([[(k * 3 + j * 5) % 7 / 7.0 - 0.4 for j in range(8)] for k in range(64)])
    out = descent.fit_codes(seen, weights, np.zeros(64), 100, descent.Schedule(rate=0.02))
    return out.select("sample_id", *rounded(first_loss=F.col("first_loss"), loss=F.col("loss")), "steps")


@op("G7_shape_reconstruction", f"WITH m AS (SELECT CAST(k AS INT) AS k, avg(CAST(embedding[k+1] AS DOUBLE)) AS mean FROM embeddings, (SELECT unnest(range(64)) AS k) GROUP BY 1), z AS (SELECT sample_id, dim, mu FROM {x.CODES} WHERE dim < 5) SELECT z.sample_id, m.k, round(sum(((m.k*3+z.dim*5)%7/10.0-0.3)*z.mu)+max(m.mean),6)+0.0 AS value FROM z, m GROUP BY 1, 2")
def shape_reconstruction(spark, sf):
    """basis x code + mean: 64 cells, 5 components."""
    mean = x.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    codes = x.codes(spark, sf).where("dim < 5").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    basis = ((F.col("k") * 3 + F.col("dim") * 5) % 7) / 10.0 - 0.3
    return codes.groupBy("sample_id", "k").agg(F.sum(basis * F.col("mu")).alias("v")).join(F.broadcast(mean), "k").select("sample_id", "k", r6(F.col("v") + F.col("mean")).alias("value"))


# Sorts and samples.
add("O1_natural_order", lambda s, d: x.table(s, d, "documents").select("source").distinct().select("source", strings.natural_key(F.col("source")).alias("key")), "SELECT DISTINCT source, 'src' || lpad(replace(source, 'src', ''), 12, '0') AS key FROM documents")
add("O2_latest", lambda s, d: x.table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("latest")), "SELECT user_id, arg_max(event_type, event_id) AS latest FROM events GROUP BY 1")
add("O3_every_nth", lambda s, d: sampling.every_nth(x.detections(s, d), "det_id", 3, "frame").select("frame", "det_id"), f"SELECT frame, det_id FROM {x.DETECTIONS} QUALIFY (row_number() OVER (PARTITION BY frame ORDER BY det_id)-1) % 3 = 0")
add("O4_smallest_k", lambda s, d: spatial.nearest(x.points(s, d).withColumnRenamed("point_id", "query_id"), x.points(s, d), 2, 12.0, writer(s), within=12.0).select("query_id", "point_id"),
    f"SELECT q.point_id AS query_id, p.point_id FROM {x.POINTS} q JOIN {x.POINTS} p USING (cloud_id) WHERE pow(q.x-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2) <= 144 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY pow(q.x-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2), p.point_id) <= 2")
add("O5_selection", lambda s, d: x.points(s, d).groupBy("cloud_id").agg(r6(F.percentile("y", F.lit(0.25))).alias("q1")), f"SELECT cloud_id, {R(q1='quantile_cont(y, 0.25)')} FROM {x.POINTS} GROUP BY 1")
add("O6_disjoint_split", lambda s, d: sampling.exact_split(x.table(s, d, "documents"), "doc_id", {"train": 0.45, "test": 0.45, "val": 0.1}, "source"),
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('split:'||doc_id), doc_id)-1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, CASE WHEN k < floor(0.45*n) THEN 'train' WHEN k < 2*floor(0.45*n) THEN 'test' ELSE 'val' END AS part FROM r WHERE k < 2*floor(0.45*n)+floor(0.1*n)")
add("O6_hash_split", lambda s, d: sampling.split(x.table(s, d, "documents"), "doc_id", {"train": 0.5, "test": 0.3}), "SELECT doc_id, CASE WHEN u < 0.5 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, CAST('0x'||substr(md5('split:'||doc_id),1,8) AS BIGINT)/4294967296.0 AS u FROM documents) WHERE u < 0.8")
add("O7_minibatch", lambda s, d: sampling.minibatch(x.table(s, d, "embeddings").select("vec_id"), "vec_id", 32, 4), "SELECT vec_id FROM embeddings ORDER BY md5('4:'||vec_id), vec_id LIMIT 32")
HASHED = lambda name: f"(CAST('0x'||substr(md5('{name}:'||mesh_id||':'||k),1,8) AS BIGINT)/4294967296.0)"
add("O8_surface_samples", lambda s, d: sampling.surface_points(x.triangles(s, d), 100).select("mesh_id", "k", "fid", *rounded(**{c: F.col(c) for c in "xyz"})),
    f"WITH a AS (SELECT *, sum({AREA}) OVER (PARTITION BY mesh_id ORDER BY fid ROWS UNBOUNDED PRECEDING)/sum({AREA}) OVER (PARTITION BY mesh_id) AS hi FROM {x.TRIANGLES}), b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY mesh_id ORDER BY fid), 0) AS lo FROM a), n AS (SELECT mesh_id, k, {HASHED('face')} AS u, sqrt({HASHED('r')}) AS r, {HASHED('s')} AS s FROM (SELECT DISTINCT mesh_id FROM a), (SELECT unnest(range(100)) AS k)) SELECT n.mesh_id, n.k, b.fid, {R(**{c: f'(1-r)*a{c}+r*(1-s)*k{c}+r*s*c{c}' for c in 'xyz'})} FROM n JOIN b ON b.mesh_id = n.mesh_id AND lo <= u AND u < hi")


@op("O9_perturbations")
def perturbations(spark, sf):
    """Random poses; tests check counts, ranges and repeatability."""
    return sampling.perturbed(x.points(spark, sf), "point_id", 3).select("point_id", "copy", *rounded(**{c: F.col(c) for c in "xyz"}))


add("O10_padded_copies", lambda s, d: sampling.padded_copies(x.boxes(s, d), 3, 0.1).select("box_id", "copy", *rounded(**{c: F.col(c) for c in ("sx", "sy", "sz", "tx")})), f"SELECT box_id, CAST(k AS INT) AS copy, {R(sx='sx*1.2', sy='sy*1.2', sz='sz*1.2', tx='tx')} FROM {x.BOXES}, (SELECT unnest(range(3)) AS k)")
NOISE = lambda name: f"(CAST('0x'||substr(md5('{name}:'||point_id),1,8) AS BIGINT)/4294967296.0)"
add("O11_depth_noise", lambda s, d: x.points(s, d).select("point_id", r6(sampling.noisy_depth(F.col("z"), 0.075, 70.0, 15.0, tensors.uniform_of(F.lit("drop"), F.col("point_id").cast("string")), tensors.uniform_of(F.lit("noise"), F.col("point_id").cast("string")))).alias("depth")),
    f"SELECT point_id, {R(depth=f'CASE WHEN {NOISE("drop")} < 0.075 THEN 15.0 ELSE z - ln(1-{NOISE("noise")})/70.0 END')} FROM {x.POINTS}")

# Meshes.
add("J19_adjacency", lambda s, d: mesh.vertex_faces(grid_mesh(s, d)[1]), f"SELECT f.mesh_id, f.vid, f.faces, n.neighbours FROM (SELECT mesh_id, vid, count(DISTINCT fid) AS faces FROM (SELECT mesh_id, fid, unnest([v0,v1,v2]) AS vid FROM {SHEET_F}) GROUP BY 1, 2) f JOIN (SELECT mesh_id, vid, count(DISTINCT o) AS neighbours FROM (SELECT mesh_id, u AS vid, v AS o FROM {SHEET_E} UNION ALL SELECT mesh_id, v, u FROM {SHEET_E}) GROUP BY 1, 2) n USING (mesh_id, vid)")
add("R1_cleanup", lambda s, d: mesh.cleaned(x.table(s, d, "embeddings").selectExpr("CAST(label AS BIGINT) AS mesh_id", "vec_id AS fid", "vec_id % 7 AS v0", "vec_id % 5 AS v1", "vec_id % 3 AS v2")),
    "WITH f AS (SELECT CAST(label AS BIGINT) AS mesh_id, vec_id AS fid, vec_id % 7 AS v0, vec_id % 5 AS v1, vec_id % 3 AS v2 FROM embeddings) SELECT * FROM f WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2 QUALIFY row_number() OVER (PARTITION BY mesh_id, list_sort([v0, v1, v2]) ORDER BY fid) = 1")
add("R0_linear_subdivision", lambda s, d: mesh.subdivided(*grid_mesh(s, d)).select("mesh_id", "u", "v", *rounded(**{c: F.col(c) for c in "xyz"})), f"SELECT e.mesh_id, e.u, e.v, {R(**{c: f'(a.{c}+b.{c})/2' for c in 'xyz'})} FROM (SELECT DISTINCT mesh_id, u, v FROM {SHEET_E}) e JOIN {SHEET_V} a ON a.vid = e.u JOIN {SHEET_V} b ON b.vid = e.v")
add("R9_loop_edges", lambda s, d: mesh.subdivided(*grid_mesh(s, d), loop=True).select("mesh_id", "u", "v", *rounded(**{c: F.col(c) for c in "xyz"})),
    f"SELECT e.mesh_id, e.u, e.v, {R(**{c: f'CASE WHEN n = 2 THEN 0.375*(a.{c}+b.{c})+o{c}/8 ELSE (a.{c}+b.{c})/2 END' for c in 'xyz'})} FROM (SELECT s.mesh_id, u, v, count(*) AS n, sum(p.x) AS ox, sum(p.y) AS oy, sum(p.z) AS oz FROM {SHEET_E} s JOIN {SHEET_V} p ON p.vid = s.o GROUP BY 1, 2, 3) e JOIN {SHEET_V} a ON a.vid = e.u JOIN {SHEET_V} b ON b.vid = e.v")
AROUND = f"(SELECT mesh_id, u AS vid, v AS o FROM {SHEET_E} UNION SELECT mesh_id, v, u FROM {SHEET_E})"
add("R9_loop_vertices", lambda s, d: mesh.even_vertices(*grid_mesh(s, d)).select("mesh_id", "vid", *rounded(**{c: F.col(c) for c in "xyz"})),
    f"SELECT v.mesh_id, v.vid, {R(**{c: f'v.{c}*(1-n*b)+o{c}*b' for c in 'xyz'})} FROM {SHEET_V} v JOIN (SELECT a.vid, count(*) AS n, (0.625-pow(0.375+cos(2*pi()/count(*))/4,2))/count(*) AS b, sum(p.x) AS ox, sum(p.y) AS oy, sum(p.z) AS oz FROM {AROUND} a JOIN {SHEET_V} p ON p.vid = a.o GROUP BY 1) s ON s.vid = v.vid")
add("R5_density_smoothing", lambda s, d: mesh.smoothed_values(grid_mesh(s, d)[0].withColumnRenamed("z", "value"), grid_mesh(s, d)[1]).select("mesh_id", "vid", r6(F.col("value")).alias("value")), f"SELECT a.mesh_id, a.vid, {R(value='avg(p.z)')} FROM {AROUND} a JOIN {SHEET_V} p ON p.vid = a.o GROUP BY 1, 2")


def sheet_triangles(spark, sf):
    v, f = grid_mesh(spark, sf)
    return mesh.with_corners(f, v), f


def corner(alias: str, p: str) -> str:
    return ", ".join(f"{alias}.{n} AS {p}{n}" for n in "xyz")


SHEET_T = f"(SELECT f.mesh_id, f.fid, {corner('p', 'a')}, {corner('q', 'k')}, {corner('r', 'c')} FROM {SHEET_F} f JOIN {SHEET_V} p ON p.vid = v0 JOIN {SHEET_V} q ON q.vid = v1 JOIN {SHEET_V} r ON r.vid = v2)"
NORMALS = f"(SELECT fid, {cross_sql('x')} AS nx, {cross_sql('y')} AS ny, {cross_sql('z')} AS nz FROM {SHEET_T})"
FEATURES = f"SELECT mesh_id, u, v, CASE WHEN n = 1 THEN 'contour' ELSE 'crease' END AS kind FROM (SELECT e.mesh_id, e.u, e.v, count(*) AS n, list(struct_pack(x := nx, y := ny, z := nz) ORDER BY e.fid) AS s FROM {SHEET_E} e JOIN {NORMALS} m USING (fid) GROUP BY 1, 2, 3) WHERE n = 1 OR (n = 2 AND (s[1].x*s[2].x+s[1].y*s[2].y+s[1].z*s[2].z)/(sqrt(s[1].x*s[1].x+s[1].y*s[1].y+s[1].z*s[1].z)*sqrt(s[2].x*s[2].x+s[2].y*s[2].y+s[2].z*s[2].z)) < 0.7)"
add("R3_feature_edges", lambda s, d: mesh.feature_edges(*sheet_triangles(s, d), 0.7), FEATURES)
add("R4_skeleton_corners", lambda s, d: mesh.feature_degrees(mesh.feature_edges(*sheet_triangles(s, d), 0.7)).where("n <> 2"), f"SELECT mesh_id, vid, count(*) AS n FROM (SELECT mesh_id, unnest([u, v]) AS vid FROM ({FEATURES})) GROUP BY 1, 2 HAVING count(*) <> 2")


def walked(features: str) -> str:
    """The chains of feature edges as walks, edge by edge: open ones from a corner, closed ones from the least vertex of their circle."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT mesh_id, u, v FROM ({features})), b AS (SELECT mesh_id, u, v FROM e UNION ALL SELECT mesh_id, v, u FROM e),
n AS (SELECT mesh_id, u, count(*) AS n FROM b GROUP BY 1, 2), corner AS (SELECT mesh_id, u FROM n WHERE n <> 2),
w AS (SELECT mesh_id, u AS first, v AS second, u AS prev, v AS tip, CAST(1 AS BIGINT) AS place FROM b SEMI JOIN corner USING (mesh_id, u)
    UNION ALL SELECT w.mesh_id, first, second, w.tip, b.v, place+1 FROM w JOIN b ON b.mesh_id = w.mesh_id AND b.u = w.tip AND b.v <> w.prev WHERE NOT EXISTS (SELECT 1 FROM corner c WHERE c.mesh_id = w.mesh_id AND c.u = w.tip)),
ends AS (SELECT mesh_id, first, second, tip AS last, prev AS pre FROM w SEMI JOIN (SELECT mesh_id, u AS tip FROM corner) USING (mesh_id, tip)),
mine AS (SELECT * FROM ends WHERE first < last OR (first = last AND second < pre)),
opened AS (SELECT DISTINCT mesh_id, first, second, place, tip AS vid FROM w SEMI JOIN mine USING (mesh_id, first, second) UNION SELECT mesh_id, first, second, 0, first FROM mine),
free AS (SELECT b.* FROM b ANTI JOIN (SELECT mesh_id, vid AS u FROM opened) USING (mesh_id, u)),
low AS (SELECT mesh_id, u, u AS r FROM (SELECT DISTINCT mesh_id, u FROM free) UNION SELECT l.mesh_id, f.v, l.r FROM low l JOIN free f ON f.mesh_id = l.mesh_id AND f.u = l.u WHERE l.r < f.v),
roots AS (SELECT mesh_id, u, min(r) AS r FROM low GROUP BY 1, 2),
c AS (SELECT mesh_id, u AS first, min(v) AS second, u AS prev, min(v) AS tip, CAST(1 AS BIGINT) AS place FROM free SEMI JOIN (SELECT mesh_id, u FROM roots WHERE u = r) USING (mesh_id, u) GROUP BY 1, 2
    UNION ALL SELECT c.mesh_id, first, second, c.tip, f.v, place+1 FROM c JOIN free f ON f.mesh_id = c.mesh_id AND f.u = c.tip AND f.v <> c.prev WHERE f.v <> c.first)
SELECT *, false AS closed FROM opened UNION ALL SELECT mesh_id, first, second, place, tip, true FROM c UNION ALL SELECT mesh_id, first, second, CAST(0 AS BIGINT), first, true FROM c WHERE place = 1"""


add("R4_backbones", lambda s, d: remesh.backbones(mesh.feature_edges(*sheet_triangles(s, d), 0.7), writer(s)), walked(FEATURES))
add("R4_contour_circles", lambda s, d: remesh.backbones(mesh.feature_edges(*sheet_triangles(s, d), 0.7).where("kind = 'contour'"), writer(s)), walked(f"SELECT * FROM ({FEATURES}) WHERE kind = 'contour'"))
LEANING = f"(SELECT vec_id // 256 AS mesh_id, vec_id AS vid, CAST(vec_id % 16 AS DOUBLE)+0.5*{x.E(2)}+1.7*((vec_id % 256) // 16 + 0.5*{x.E(3)}) AS x, (vec_id % 256) // 16 + 0.5*{x.E(3)} AS y, 0.0 AS z FROM embeddings)"


def leaning_mesh(spark, sf):
    """The sheets in a plane, their vertices moved and the rows shifted, so that most sides fail the circle test."""
    y = F.floor((F.col("vec_id") % 256) / 16) + 0.5 * x.e(3)
    vertices = x.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("mesh_id"), F.col("vec_id").alias("vid"), ((F.col("vec_id") % 16) + 0.5 * x.e(2) + 1.7 * y).alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return vertices, grid_mesh(spark, sf)[1]


@op("R10_delaunay", f"SELECT f.mesh_id, count(*) AS faces, {R(area='sum(abs((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x)))/2')}, CAST(0 AS BIGINT) AS failing FROM {SHEET_F} f JOIN {LEANING} p ON p.vid = v0 JOIN {LEANING} q ON q.vid = v1 JOIN {LEANING} r ON r.vid = v2 GROUP BY 1")
def delaunay(spark, sf):
    """Sides are flipped until none fails the circle test; for each mesh the faces, their area, and the inner sides that fail and whose corners are convex. Tests hold the faces against flips one by one."""
    vertices, faces = leaning_mesh(spark, sf)
    done = remesh.flipped(faces, vertices, writer(spark))
    failing = remesh.side_pairs(done, vertices).where(remesh.opposed() & remesh.convex()).groupBy("mesh_id").agg(F.count("*").alias("failing"))
    totals = mesh.areas(mesh.with_corners(done, vertices)).groupBy("mesh_id").agg(F.count("*").alias("faces"), r6(F.sum("area")).alias("area"))
    return totals.join(failing, "mesh_id", "left").select("mesh_id", "faces", "area", F.coalesce("failing", F.lit(0)).cast("long").alias("failing"))


def relaxation_sql(rounds: int, rate: float) -> str:
    """The rounds one after the other, in a plane."""
    rim = f"SELECT mesh_id, unnest([u, v]) AS vid FROM (SELECT mesh_id, u, v FROM {SHEET_E} GROUP BY 1, 2, 3 HAVING count(*) = 1)"
    faces = lambda points: f"SELECT f.mesh_id, fid, v0, v1, v2, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc, ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))/2 AS s FROM {SHEET_F} f JOIN {points} a ON a.vid = v0 JOIN {points} b ON b.vid = v1 JOIN {points} c ON c.vid = v2"
    out = [f"rim AS MATERIALIZED ({rim})", f"p0 AS MATERIALIZED (SELECT mesh_id, vid, x, y FROM {LEANING})", f"t0 AS MATERIALIZED ({faces('p0')})", "goal AS MATERIALIZED (SELECT mesh_id, avg(s) AS goal FROM t0 GROUP BY 1)", f"s0 AS MATERIALIZED (SELECT mesh_id, sum(pow(s-goal, 2)) AS energy, {rate} AS rate FROM t0 JOIN goal USING (mesh_id) GROUP BY 1)"]
    for k in range(rounds):
        pulls = " UNION ALL ".join(f"SELECT mesh_id, {v} AS vid, (s-goal)*(y{p}-y{q}) AS gx, (s-goal)*(x{q}-x{p}) AS gy FROM t{k} JOIN goal USING (mesh_id)" for v, p, q in (("v0", "b", "c"), ("v1", "c", "a"), ("v2", "a", "b")))
        out += [f"g{k} AS MATERIALIZED (SELECT mesh_id, vid, sum(gx) AS gx, sum(gy) AS gy FROM ({pulls}) GROUP BY 1, 2)", f"m{k} AS MATERIALIZED (SELECT p.mesh_id, p.vid, p.x AS ox, p.y AS oy, x-coalesce(CASE WHEN r.vid IS NULL THEN rate*gx END, 0) AS x, y-coalesce(CASE WHEN r.vid IS NULL THEN rate*gy END, 0) AS y FROM p{k} p LEFT JOIN g{k} g USING (vid) LEFT JOIN (SELECT DISTINCT vid FROM rim) r USING (vid) JOIN s{k} ON s{k}.mesh_id = p.mesh_id)",
            f"u{k} AS MATERIALIZED ({faces(f'm{k}')})", f"j{k} AS MATERIALIZED (SELECT mesh_id, energy, rate, t, t < energy AND low > 0 AS taken FROM s{k} JOIN (SELECT mesh_id, sum(pow(s-goal, 2)) AS t, min(s) AS low FROM u{k} JOIN goal USING (mesh_id) GROUP BY 1) USING (mesh_id))",
            f"p{k + 1} AS MATERIALIZED (SELECT m.mesh_id, vid, CASE WHEN taken THEN x ELSE ox END AS x, CASE WHEN taken THEN y ELSE oy END AS y FROM m{k} m JOIN j{k} USING (mesh_id))", f"t{k + 1} AS MATERIALIZED ({faces(f'p{k + 1}')})", f"s{k + 1} AS MATERIALIZED (SELECT mesh_id, CASE WHEN taken THEN t ELSE energy END AS energy, CASE WHEN taken THEN rate*1.2 ELSE rate/2 END AS rate FROM j{k})"]
    return f"WITH {', '.join(out)} SELECT mesh_id, vid, {R(x='x', y='y', energy='energy')} FROM p{rounds} JOIN s{rounds} USING (mesh_id)"


@op("R11_area_relaxation", relaxation_sql(3, 0.1))
def area_relaxation(spark, sf):
    """Three rounds on the sheets in a plane: where each vertex is then, and the sum of squared differences of its mesh's areas that is left."""
    vertices, faces = leaning_mesh(spark, sf)
    points, _ = remesh.relaxed(vertices, faces, 3, scratch := writer(spark), 0.1)
    area = scratch(mesh.areas(mesh.with_corners(faces, vertices)).groupBy("mesh_id").agg(F.avg("area").alias("goal")), "goal")
    left = mesh.areas(mesh.with_corners(faces, points)).join(area, "mesh_id").groupBy("mesh_id").agg(F.sum(F.pow(F.col("area") - F.col("goal"), F.lit(2.0))).alias("energy"))
    return points.join(left, "mesh_id").select("mesh_id", "vid", *rounded(x=F.col("x"), y=F.col("y"), energy=F.col("energy")))


@op("R8_decimation", f"SELECT mesh_id, greatest(4, n*3//4) AS vertices, v-e+f AS euler, rims FROM (SELECT mesh_id, count(*) AS n FROM {SHEET_V} GROUP BY 1) JOIN (SELECT mesh_id, count(*) AS f FROM {SHEET_F} GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS e, CAST(0 AS BIGINT) AS rims FROM (SELECT DISTINCT mesh_id, u, v FROM {SHEET_E}) GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(DISTINCT p) AS v FROM (SELECT mesh_id, unnest([u, v]) AS p FROM {SHEET_E}) GROUP BY 1) USING (mesh_id)")
def decimation(spark, sf):
    """Three quarters of each sheet's vertices stay. For each mesh: vertices, the Euler characteristic of what faces use, and border vertices with other than two border sides; tests hold the cost against collapses one by one."""
    vertices, faces = grid_mesh(spark, sf)
    budgets = vertices.groupBy("mesh_id").agg(F.greatest(F.lit(4).cast("long"), F.floor(F.count("*") * 3 / 4)).alias("budget"))
    points, left, _ = remesh.decimated(vertices, faces, budgets, writer(spark))
    sides = mesh.edges(left).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n"))
    ends = sides.select("mesh_id", "n", F.explode(F.array("u", "v")).alias("p")).groupBy("mesh_id", "p").agg(F.count_if(F.col("n") == 1).alias("rim"))
    counts = [points.groupBy("mesh_id").agg(F.count("*").alias("vertices")), left.groupBy("mesh_id").agg(F.count("*").alias("f")), sides.groupBy("mesh_id").agg(F.count("*").alias("e")), ends.groupBy("mesh_id").agg(F.count("*").alias("v"), F.count_if(~F.col("rim").isin(0, 2)).alias("rims"))]
    both = counts[0]
    for some in counts[1:]:
        both = both.join(some, "mesh_id")
    return both.select("mesh_id", "vertices", (F.col("v") - F.col("e") + F.col("f")).alias("euler"), "rims")


SLICE = " UNION ALL ".join(f"SELECT mesh_id, fid, {k} AS side, {', '.join(f'{p}{c}+({p}z-0.1)/(({p}z-0.1)-({q}z-0.1))*({q}{c}-{p}{c}) AS {c}' for c in 'xyz')} FROM {SHEET_T} WHERE ({p}z-0.1)*({q}z-0.1) < 0" for k, (p, q) in enumerate((("a", "k"), ("k", "c"), ("c", "a"))))
add("R13_plane_slices", lambda s, d: mesh.sliced(sheet_triangles(s, d)[0], (0.0, 0.0, 1.0, -0.1)).select("mesh_id", "fid", "side", *rounded(**{c: F.col(c) for c in "xyz"})), f"SELECT mesh_id, fid, CAST(side AS INT) AS side, {R(x='x', y='y', z='z')} FROM ({SLICE})")
add("W7_carried_rounding", lambda s, d: mesh.teleported(mesh.areas(x.triangles(s, d)), 1000), f"WITH a AS (SELECT mesh_id, fid, floor(sum({AREA}) OVER (PARTITION BY mesh_id ORDER BY fid ROWS UNBOUNDED PRECEDING)/sum({AREA}) OVER (PARTITION BY mesh_id)*1000+0.5) AS u FROM {x.TRIANGLES}) SELECT mesh_id, fid, CAST(u-coalesce(lag(u) OVER (PARTITION BY mesh_id ORDER BY fid), 0) AS BIGINT) AS n FROM a")
add("R6_surface_counts", lambda s, d: mesh.teleported(mesh.areas(x.triangles(s, d)), 500).groupBy("mesh_id").agg(F.sum("n").alias("n")), f"SELECT DISTINCT mesh_id, CAST(500 AS BIGINT) AS n FROM {x.TRIANGLES}")


@op("J18_merged_vertices")
def merged_vertices(spark, sf):
    """Order-dependent merging; tests hold it against a plain loop."""
    points = x.points(spark, sf).select(F.col("cloud_id").alias("mesh_id"), F.col("point_id").alias("vid"), "x", "y", "z")
    return mesh.merged_vertices(points, 2.0)


@op("R14_average_plane")
def average_plane(spark, sf):
    """Normal of least spread of each cloud, from its covariance; tests hold it against a plain version."""
    return spatial.average_planes(x.points(spark, sf)).select("cloud_id", *rounded(nx=F.abs("nx"), ny=F.abs("ny"), nz=F.abs("nz")))


