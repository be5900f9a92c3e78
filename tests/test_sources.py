"""Readers and writers on small files of each kind."""

from strandwork.operators import connectivity as N
from strandwork.operators import voxels as X
from strandwork.sources import sinks as O
from strandwork.sources import tracker as R

XML = """<?xml version="1.0"?><Tracker><Model><AllSpots nspots="3"><SpotsInFrame frame="0"><Spot ID="1" name="a" FRAME="0" POSITION_X="1.5" POSITION_Y="2" POSITION_Z="0" RADIUS="3" QUALITY="1" TOTAL_INTENSITY_CH1="9"/></SpotsInFrame>
<SpotsInFrame frame="1"><Spot ID="2" FRAME="1" POSITION_X="2.5" POSITION_Y="2" POSITION_Z="0" RADIUS="3" QUALITY="1"/><Spot ID="3" FRAME="1" POSITION_X="0.5" POSITION_Y="2" POSITION_Z="0" RADIUS="3" QUALITY="1"/></SpotsInFrame></AllSpots>
<AllTracks><Track TRACK_ID="0" TRACK_DISPLACEMENT="1.0" TOTAL_DISTANCE_TRAVELED="2.0" MAX_DISTANCE_TRAVELED="1.0" TRACK_DURATION="1.0"><Edge SPOT_SOURCE_ID="1" SPOT_TARGET_ID="2"/><Edge SPOT_SOURCE_ID="1" SPOT_TARGET_ID="3"/></Track></AllTracks>
<FilteredTracks><TrackID TRACK_ID="0"/></FilteredTracks></Model><Settings><ImageData pixelwidth="0.5" pixelheight="0.5" voxeldepth="2.0" timeinterval="0.0"/><DetectorSettings TARGET_CHANNEL="2"/><BasicSettings tstart="0" tend="9" xstart="0" xend="99" ystart="0" yend="98"/></Settings></Tracker>"""


def test_xml(spark, tmp_path):
    path = f"{tmp_path}/t.xml"
    (tmp_path / "t.xml").write_text(XML)
    spots = {r.spot_id: r for r in R.read_spots_xml(spark, path).collect()}
    assert sorted(spots) == [1, 2, 3] and spots[1].x == 1.5 and spots[1].total_intensity_ch1 == 9 and spots[2].total_intensity_ch1 is None
    assert sorted(tuple(r) for r in R.read_edges_xml(spark, path).collect()) == [(0, 1, 2), (0, 1, 3)]
    assert [tuple(r) for r in R.read_tracks_xml(spark, path).collect()] == [(0, 1.0, 2.0, 1.0, 1.0)]
    assert [r.track_id for r in R.read_filtered_tracks_xml(spark, path).collect()] == [0]
    c = R.read_calibration_xml(spark, path).first()
    assert (c.x_size, c.z_size, c.interval, c.channel, c.tend, c.xend) == (0.5, 2.0, 1.0, 2, 9.0, 99.0)


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("LABEL,ID,TRACK_ID,POSITION_X,POSITION_Y,POSITION_Z,FRAME\nLabel,Spot ID,Track,X,Y,Z,Frame\nLabel,ID,ID,X,Y,Z,F\n,,,(um),(um),(um),\na,7,0,9.9,4,2,3\n")
    assert [(r.spot_id, r.x, r.y, r.z) for r in R.read_spots_csv(spark, f"{tmp_path}/s.csv", (1.0, 2.0, 0.5)).collect()] == [(7, 19, 2, 2)]
    (tmp_path / "e.csv").write_text("LABEL,TRACK_ID,SPOT_SOURCE_ID,SPOT_TARGET_ID,SPEED\nx,y,z,w,v\na,0,1,2,0.5\nb,4,3,5,1.5\n")
    assert sorted(tuple(r) for r in R.read_edges_csv(spark, f"{tmp_path}/e.csv").collect()) == [(4, 3, 5, 1.5), (5, 1, 2, 0.5)]
    (tmp_path / "t.csv").write_text("LABEL,TRACK_ID,LINEARITY,TRACK_DURATION\nx,y,z,w\na,0,0.5,2.0\nb,1,0.25,7.12345\n")
    assert sorted(tuple(r) for r in R.read_tracks_csv(spark, f"{tmp_path}/t.csv").collect()) == [(0, 1.5, 2.0), (1, 1.25, 7.123)]
    (tmp_path / "a.csv").write_text("axis-0,axis-1,axis-2\n1,2,3\n")
    (tmp_path / "b.csv").write_text("T,Z,Y,X\n5,1,2,3\n")
    assert [[tuple(r) for r in R.read_annotations(spark, f"{tmp_path}/{f}.csv", 8).collect()] for f in "ab"] == [[(8, 1.0, 2.0, 3.0)], [(5, 1.0, 2.0, 3.0)]]
    (tmp_path / "d.csv").write_text("T,Z,Y,X,Score\n5,1,2,3,0.75\n")
    assert [tuple(r) for r in R.read_detections(spark, f"{tmp_path}/d.csv").collect()] == [(5, 1.0, 2.0, 3.0, 0.75)]


def test_writers(spark, tmp_path):
    spots = spark.createDataFrame([(1, 0, 1.0, "A"), (2, 1, 2.0, "B")], "ID long, FRAME long, RADIUS double, label string")
    O.write_enriched_spots(spots.drop("label"), f"{tmp_path}/x", "xml")
    assert R.read_spots_xml(spark, f"{tmp_path}/x").count() == 2
    O.write_class_tables(spots, f"{tmp_path}/c")
    assert sorted(r.label for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()) == ["A", "B"]
    O.write_feature_slices(spots.withColumnRenamed("ID", "spot_id"), "label", ["RADIUS"], f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2


def test_barcode_and_components(spark):
    """A frame's barcode is the lengths of its minimum spanning tree; the largest part of a mask is found across a bend."""
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 1.0), (3, 0, 0.0, 0.0, 3.0), (4, 0, 0.0, 4.0, 0.0), (5, 1, 0.0, 0.0, 0.0)], "spot_id long, frame long, z double, y double, x double")
    bars = N.component_barcode(points, N.rips_edges(points, 10.0))
    assert sorted((r.frame, r.death) for r in bars.collect()) == [(0, 1.0), (0, 2.0), (0, 4.0)]
    on = [(0, 0, y, x) for y, x in [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (5, 5), (5, 6)]]
    voxels = spark.createDataFrame([(*p, 1, 1) for p in on], "t long, z long, y long, x long, value long, label long")
    assert sorted((r.y, r.x) for r in X.largest_component(voxels).collect()) == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
