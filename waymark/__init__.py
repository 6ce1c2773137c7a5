"""waymark: landmark tables on multichannel recordings, analysed with Spark DataFrames."""

from .schema import LANDMARKS_11, Keys, Landmarks, Wave

__all__ = ["Keys", "Landmarks", "Wave", "LANDMARKS_11"]
