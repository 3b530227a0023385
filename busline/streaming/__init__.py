"""busline.streaming"""
