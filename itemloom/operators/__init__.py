"""Operators over item banks as DataFrame functions."""
